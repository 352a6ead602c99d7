"""Operator 9: WARC archives with revisit records.

``write_archives`` shuffles the headers (id, digest, length) by payload digest; of records with equal
payloads the one with the smallest id is written as response and the others as revisit records without
a payload. Spark's own text writer writes the archives, a record a row, ended by the two line ends that
the format asks for, so a lost executor's part is simply written again. ``read_archives`` reads such
archives as a stream of records, checks the digests of payloads, and joins revisit records to the
responses that they refer to.

Each record has an id of its own, made of its digest and key, and for rows that repeat both of their number as well; keys are
kept in the header X-Key. Revisit records name their response's key, and its record id unless that row is repeated.
A revisit record whose response isn't in the archives stays, without a length.

Null payload: empty. Empty payloads are equal payloads unless min_bytes is 1 or more. Null ids: such a
record is a response unless a record with an id has the same payload. Rows with the same id and payload
are all responses. Null url: no target header; line ends in urls are percent-encoded. Further columns
are dropped. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import save

#: Fixed values of the format.
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "record_id string, record_type string, target string, payload_digest string, refers_to string, key string, refers_to_key string, payload binary, payload_bytes long"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hex string whose length is a multiple of 5, as SHA-1's is: 5 digits are 4 letters."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def resolve(df: DataFrame, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """id, url, payload, payload_bytes, payload_digest, first_id: the id of the response, null in responses; and the record ids urn and first_urn."""
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    records = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"))
    # a row for each digest and id; read from there, Spark knows the sizes, and may split hot digests
    headers = save(records.groupBy("digest", "id").agg(F.count("*").alias("n"), F.max("payload_bytes").alias("bytes")), "warc-headers")
    repeated = headers.where("n > 1").select(F.col("digest").alias("repeated_digest"), F.col("id").alias("repeated_id"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    shared = headers.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(first, F.sum("n").alias("all")).where((F.col("all") > 1) & F.col("first").isNotNull())
    shared = save(shared.select("digest", F.col("first.id").alias("first_id"), (F.col("first.n") > 1).alias("first_repeats")), "warc-shared")
    joined = records.join(shared, "digest", "left").join(save(repeated, "warc-repeated"), (F.col("digest") == F.col("repeated_digest")) & F.col("id").eqNullSafe(F.col("repeated_id")), "left")
    first = F.when(~F.col("id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= min_bytes), F.col("first_id"))
    nth = F.when(F.col("repeated_digest").isNotNull(), F.monotonically_increasing_id().cast("string"))
    own = joined.select("id", "url", "payload", "payload_bytes", "digest", first.alias("first_id"), "first_repeats", nth.alias("nth"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    first_urn = F.when(F.col("first_id").isNotNull() & ~F.col("first_repeats"), _urn(F.col("digest"), text("first_id")))
    return own.select("id", "url", "payload", "payload_bytes", base32(F.col("digest")).alias("payload_digest"), "first_id", _urn(F.col("digest"), text("id"), F.col("nth")).alias("urn"), first_urn.alias("first_urn"))


def write_archives(df: DataFrame, path: str, date: str | None = None, content_type: str = "text/html", **columns) -> None:
    """Archives of df's records, one a task, in the folder path: gzip files with fresh headers. date: now, if none is given."""
    r = resolve(df, **columns)
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("first_id").isNotNull()
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    body = F.when(revisit, "").otherwise(F.col("payload"))
    header = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.col("urn")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Refers-To: "), F.col("first_urn")),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.concat(F.lit("X-Key: "), F.col("id").cast("string")),
        F.concat(F.lit("X-Refers-To-Key: "), F.col("first_id").cast("string")),
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *header), F.lit(END), body)
    r.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class _Records:
    """Cuts files, each given as consecutive chunks that END stood between, into records."""

    def __init__(self):
        self.file = None

    def feed(self, file: str, chunk: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        if file != self.file:
            self.file, self.bytes, self.skip, self.header = file, bytearray(chunk), 0, None
        else:
            self.bytes += END.encode() + chunk
        while True:
            if self.skip:
                took = min(self.skip, len(self.bytes))
                del self.bytes[:took]
                self.skip -= took
            if self.header is None:
                at = -1 if self.skip else self.bytes.find(END.encode())
                if at < 0:
                    return
                self.header = dict(line.split(": ", 1) for line in self.bytes[:at].decode().split("\r\n")[1:])
                del self.bytes[: at + len(END)]
            need = int(self.header["Content-Length"])
            if len(self.bytes) < need:
                return
            payload, header = bytes(self.bytes[:need]), self.header
            del self.bytes[:need]
            self.header, self.skip = None, len(END)
            yield header, payload


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[c.split()[1]]) for c in PARSED.split(", ")])
    records = _Records()
    for batch in batches:
        rows = []
        for file, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for header, payload in records.feed(file, chunk):
                kind, digest = header["WARC-Type"], header["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"record {header['WARC-Record-ID']} of {file} isn't what its digest says")
                own = (payload, len(payload)) if kind == "response" else (None, None)
                rows.append((header["WARC-Record-ID"], kind, header.get("WARC-Target-URI"), digest, header.get("WARC-Refers-To"), header.get("X-Key"), header.get("X-Refers-To-Key"), *own))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in a folder, as PARSED. gzip files aren't split, so a task gets the whole of a file in order."""
    files = spark.read.option("lineSep", END).schema("value string").text(path)
    return files.select("_metadata.file_path", F.col("value").cast("binary").alias("value")).mapInArrow(_parse, PARSED)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Joins revisit records by digest and key to the responses that they refer to, and gives them their payload's length. found:
    whether the response is there; without it the length stays null."""
    responses = records.where("record_type = 'response' and key is not null").groupBy("payload_digest", F.col("key").alias("refers_to_key")).agg(F.max("payload_bytes").alias("found_bytes"))
    revisits = records.where("record_type = 'revisit'").join(save(responses, "warc-responses"), ["payload_digest", "refers_to_key"], "left")
    keep = ["record_id", "record_type", "target", "payload_digest", "key", "refers_to_key"]
    whole = records.where("record_type = 'response'").select(*keep, "payload_bytes", F.lit(True).alias("found"))
    return whole.unionByName(revisits.select(*keep, F.col("found_bytes").alias("payload_bytes"), F.col("found_bytes").isNotNull().alias("found")))
