"""Documents packed into chunks of about two megabytes, a row each, that tasks hash and compare as a whole.

A step that asks something of all documents sends rows keyed by (bucket, chunk), and its answers go back to the
chunks by a join. Chunks are written once, so they and their numbers stay the same when a task runs again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .hashing import parts
from .scratch import save, setting

#: Bytes of text in a chunk.
CHUNK = 2_000_000
CHUNKS = "chunk long, ids binary, nulls binary, offsets binary, text binary, others binary, n_bytes long"
#: Rows of these tables are large: few of them in an Arrow batch.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def batch_of(columns: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in columns]


def bits_for(total: int, bucket: int) -> int:
    """Leading bits of a hash that deal so many bytes to buckets of this size: at least 8 buckets, and at most 2^32."""
    return min(32, max(3, (total // bucket).bit_length()))


def runs(values: np.ndarray) -> dict[int, tuple[int, int]]:
    """Of sorted values: where each begins and ends."""
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))
    return dict(zip(values[at].tolist(), zip(at.tolist(), np.append(at, len(values))[1:].tolist(), strict=True), strict=True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        for rows, text, offsets in parts(ids, texts, CHUNK):
            s = slice(rows[0], rows[-1] + 1)
            others = pa.BufferOutputStream()
            with pa.ipc.new_stream(others, pa.schema(list(batch.schema)[2:])) as out:
                out.write_batch(batch.select(batch.schema.names[2:]).slice(rows[0], len(rows)))
            yield batch_of(CHUNKS, [(n, ids[s].tobytes(), nulls[s].tobytes(), offsets.astype(np.int64).tobytes(), text.tobytes(), others.getvalue().to_pybytes(), len(text))])
            n += 1


def pack(docs: DataFrame, name: str) -> DataFrame:
    """docs: id long, text, and further columns; null ids are 0 with a flag in nulls. others has the further columns in Arrow's stream format."""
    with setting(docs.sparkSession, BATCH, "2000"):
        return save(docs.mapInArrow(_pack, CHUNKS), name)
