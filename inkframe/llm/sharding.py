"""Operator 10: sharding by sampled splitters; shards of nearly equal bytes.

``shard`` orders the rows by (hash of the text, id, number), so that equal texts are neighbours and no two rows are equal, and
cuts that order into shards of equal bytes:

1. a size-weighted sample of keys, of bounded size, gives splitters, and rows are dealt to the ranges
   between them, ``MOST_RANGES`` about; ranges that come out overfull are sampled again and subdivided;
2. a window in each range gives each row the bytes before it; the ranges' totals, a bounded table, turn
   that into bytes before it in the whole order, and so into its shard and its slot there.

What the driver holds is bounded by the number of ranges, whatever the number of rows. The sample only decides how the
work is spread: shards and slots are exact whatever it holds. Equal texts
of no more than the largest row or a twentieth of a shard in all stay in one shard, so a shard differs
from the mean by no more than that; larger groups are cut like other rows.

Null text: no bytes, its checksum 0, in the group of empty texts. Null ids go first in their group.
Repeated rows are rows of their own. An empty table gives no rows. Further columns are dropped.
"""

from __future__ import annotations

import bisect
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, save

#: Sampled keys a range, and most ranges before any is subdivided: more rows make longer ranges.
OVERSAMPLE, MOST_RANGES = 24, 4_096
#: Groups of equal texts of up to this part of a shard stay whole.
WHOLE = 20
_LEAST = -(1 << 63)


Key = tuple[int, int, int]


def _sample(rows: DataFrame, weight: Column, wanted: int, seed: int) -> list[Key]:
    """Keys drawn with a chance of wanted x weight (weights add up to 1): about wanted, or twice that at most."""
    chance = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return sorted((r.key, r.pos, r.row) for r in rows.where(chance < weight * F.lit(wanted)).select("key", "pos", "row").toLocalIterator())


def _splitters(sample: list[Key], n: int, large: set[int]) -> set[Key]:
    """n - 1 quantiles; in front of the whole group of equal texts unless it is large."""
    picked = [sample[i * len(sample) // n] for i in range(1, n)] if sample else []
    return {(key, pos, row) if key in large else (key, _LEAST, _LEAST) for key, pos, row in picked}


def _ranges(splitters: list[Key]) -> Column:
    keys = np.array([s[0] for s in splitters], np.int64)

    @F.arrow_udf("int")
    def which(key: pa.Array, pos: pa.Array, row: pa.Array) -> pa.Array:
        own = key.to_numpy()
        out = np.searchsorted(keys, own, "right")
        for i in np.flatnonzero(np.searchsorted(keys, own) < out).tolist():  # keys that are splitters' own
            out[i] = bisect.bisect_right(splitters, (int(own[i]), pos[i].as_py(), row[i].as_py()))
        return pa.array(out, pa.int32())

    return which("key", "pos", "row")


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, rows_a_range: int = 200_000, seed: int = 7) -> DataFrame:
    """A row for each row of df: id, size (bytes of the text and overhead), text_crc32, shard and slot."""
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = save(
        df.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("key"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LEAST)).alias("pos"), F.monotonically_increasing_id().alias("row")),
        "shard-rows",
    )
    n, total, largest = rows.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    if not n:
        drop(rows)
        return spark.createDataFrame([], f"{id_col} {df.schema[id_col].dataType.simpleString()}, size long, text_crc32 long, shard int, slot long")
    whole = max(largest, total // shards // WHOLE)
    # groups of more than a twentieth of a shard: fewer than 20 a shard
    large = {r.key for r in rows.groupBy("key").agg(F.sum("size").alias("b")).where(F.col("b") > whole).select("key").collect()}
    weight = F.col("size") / F.lit(2.0 * total) + F.lit(0.5 / n)  # half by bytes and half by rows: neither may fill a task
    n_ranges = max(8 * shards, min(MOST_RANGES, -(-n // rows_a_range)))
    splitters = sorted(_splitters(_sample(rows, weight, n_ranges * OVERSAMPLE, seed), n_ranges, large))
    for again in (1, 2):
        load = rows.withColumn("range", _ranges(splitters)).groupBy("range").agg(F.sum(weight).alias("part")).where(F.col("part") > 2.0 / n_ranges).collect()
        if not load:
            break
        more = set(splitters)
        over = {r.range: r.part for r in load}
        inside = _sample(rows.withColumn("range", _ranges(splitters)).where(F.col("range").isin(list(over))), weight, n_ranges * OVERSAMPLE, seed + again)
        for r, own in groupby(inside, key=lambda x: bisect.bisect_right(splitters, x)):
            more |= _splitters(list(own), int(over[r] * n_ranges) + 1, large)
        if len(more) == len(splitters):
            break  # what is left are groups that stay whole
        splitters = sorted(more)
    # the two windows need one sort: each range is in the order of the key, and a group is a run in it
    in_range = Window.partitionBy("range").orderBy("key", "pos", "row")
    in_group = Window.partitionBy("range", "key").orderBy("pos", "row")
    placed = rows.withColumn("range", _ranges(splitters)).withColumn("before", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.withColumn("before", F.coalesce("before", F.lit(0)))
    placed = placed.withColumn("start", F.when(F.col("key").isin(list(large)), F.col("before")).otherwise(F.first("before").over(in_group)))
    placed = save(placed.select("id", "size", "crc", "key", "pos", "row", "range", "start"), "shard-placed")
    offset, offsets = 0, []
    for r in placed.groupBy("range").agg(F.sum("size").alias("b")).orderBy("range").toLocalIterator():
        offsets.append((r.range, offset))
        offset += r.b
    # a row for each range, so bounded by n_ranges and the subdivisions
    offsets = F.broadcast(spark.createDataFrame(offsets, "range int, offset long"))
    dealt = placed.join(offsets, "range").withColumn("shard", F.expr(f"cast((offset + start) * {shards} div {total} as int)"))
    w = Window.partitionBy("range").orderBy("shard", "key", "pos", "row")
    dealt = save(dealt.select("id", "size", "crc", "range", "shard", F.row_number().over(w).alias("nth")), "shard-dealt")
    seen, base = dict.fromkeys(range(shards), 0), []
    for r in dealt.groupBy("range", "shard").agg(F.count("*").alias("n"), F.min("nth").alias("first")).orderBy("range", "shard").toLocalIterator():
        base.append((r.range, r.shard, seen[r.shard] - r.first))
        seen[r.shard] += r.n
    drop(rows)
    drop(placed)
    # a range lies in one shard or in neighbouring ones: ranges and shards together bound these rows
    base = F.broadcast(spark.createDataFrame(base, "range int, shard int, base long"))
    return dealt.join(base, ["range", "shard"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("nth") + F.col("base")).cast("long").alias("slot"))
