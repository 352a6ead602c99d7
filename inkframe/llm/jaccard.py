"""Operator 3: Jaccard join on word shingles: size-banded tiles with hashed bitmap signatures.

``similar`` links documents whose sets of word shingles have 100 * |x and y| >= percent * |x or y|, and
gives each document the smallest id that its links reach. No link is lost:

1. *Keys.* Chunks of documents send the distinct hashes of their shingles to buckets and get back how many
   documents have each, as a power of 2. A set of which fewer than percent shingles are in another
   document has no link. With the shingles in any one order that all documents share, two sets that link have one
   of the first n - ceil(percent * n / 100) + 1 of their shingles in common: their keys. The order puts frequent shingles
   last, so shared passages hardly count. Equal sets are one set, of their smallest document.
2. *Families.* Each key has a smallest document. Its other documents are compared with that one first, a few hundred of them
   in a task, and what links is one class from then on.
3. *Tiles.* Keys whose other documents are of several classes stay open. Those with the same smallest other document are a
   group, of the documents that share such a key with it. Groups are cut into tiles by size band (bands are 100 / percent
   apart, so that links stay in a band or go to the next) and, where a band is too much for a task, by hash. A task has
   two tiles of a group. The documents of a group's largest class have tiles of their own, which meet those of other classes only.
4. *Signatures.* In a comparison, each set sets a bit for the hash of each shingle, in bitmaps as long as their band needs;
   sets x and y whose bitmaps differ in d bits have at most (|x| + |y| - d) / 2 shingles in common. Only pairs that pass
   that bound, and are not yet connected, get an exact intersection of sorted arrays.

Shingles are compared by 64-bit hashes of their words. Null or empty texts and texts without words have an
empty set, link with nothing and are their own component. Rows with a null id link with nothing and have no
component. Repeated rows are rows of their own; ids are keys, so rows with one id and different texts may
join each other's classes. Further columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import BATCH, batch_of, bits_for, pack, rows_of, runs
from .components import components
from .hashing import VALUES, mix, words
from .scratch import drop, save, setting

#: Bytes that aren't in words: \x20 and \x09 to \x0D; A to Z count as a to z.
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_FOLDED = VALUES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = VALUES[ord("a") : ord("z") + 1]
#: Bytes of text in a bucket of shingles.
BUCKET = 8_000_000
#: Shingles that a task holds at once.
ROWS = 2_000_000
#: Documents that a task compares with a family's smallest one.
FAMILY = 256
#: Bytes of sets in a task.
TILE = 24_000_000


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    mult = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    h, _, _, first = words(buffer, offsets, _IS_WORD, _FOLDED)
    m = max(0, len(h) - n + 1)
    s = np.zeros(m, np.uint64)
    for k in range(n):
        s += h[k : k + m] * mult[k]
    s = mix(s)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(s[a : b - n + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:  # fewer words: the whole sequence, apart from all shingles by its length
            yield mix((h[a:b] * mult[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def _print(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a = np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else np.uint64(0)
    b = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() if len(s) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Chunk:
    """The sets of a chunk's documents. Those that take part: with an id and shingles, one of equal sets."""

    def __init__(self, ids: bytes, nulls: bytes, offsets: bytes, text: bytes, n: int, bits: int):
        self.ids, self.nulls = np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool)
        self.sets = list(shingle_sets(np.frombuffer(text, np.uint8), np.frombuffer(offsets, np.int64), n))
        self.prints = [_print(s) for s in self.sets]
        seen = {p: i for i, p in reversed(list(enumerate(self.prints))) if not self.nulls[i]}
        self.taken = [i for i, (s, p) in enumerate(zip(self.sets, self.prints, strict=True)) if len(s) and seen.get(p) == i]
        # distinct leading bits of the shingles: bits for the bucket and 32 more
        entry = np.concatenate([np.empty(0, np.uint64), *(self.sets[i] for i in self.taken)]) >> np.uint64(32 - bits)
        order = np.argsort(entry)
        entry = entry[order]
        new = np.ones(len(entry), bool)
        new[1:] = entry[1:] != entry[:-1]
        self.of = np.empty(len(entry), np.int64)
        self.of[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.entry, self.count = entry[at], np.diff(at, append=len(entry))
        self.buckets = runs(self.entry >> np.uint64(32))

    def levels(self, answers: list[tuple[int, bytes]]) -> list[np.ndarray]:
        """Of each shingle of the sets that take part, the level of its number of documents: 0 if there is no other."""
        level = np.zeros(len(self.entry), np.uint8)
        for b, found in answers:
            a, z = self.buckets[b]
            size = -(-(z - a) // 8)
            several = np.unpackbits(np.frombuffer(found, np.uint8, size), count=z - a).astype(bool)
            level[a:z][several] = np.frombuffer(found, np.uint8, offset=size)
        level = level[self.of]
        return np.split(level, np.cumsum([len(self.sets[i]) for i in self.taken])[:-1]) if self.taken else []


_ENTRIES, _LEVELS = "bucket long, chunk long, entries binary, several binary, counts binary", "chunk long, bucket long, levels binary"
_SETS = "kind int, id long, n long, p1 long, p2 long, members binary, firsts binary"


def _send_entries(n: int, bits: int):
    def run(batches):
        for chunk, ids, nulls, offsets, text in rows_of(batches):
            c = Chunk(ids, nulls, offsets, text, n, bits)
            low, several, out = (c.entry & np.uint64(0xFFFFFFFF)).astype(np.uint32), c.count > 1, []
            for b, (a, z) in c.buckets.items():
                s = slice(a, z)
                out.append((b, chunk, low[s].tobytes(), np.packbits(several[s]).tobytes(), c.count[s][several[s]].astype(np.uint32).tobytes()))
            yield batch_of(_ENTRIES, out)

    return run


def _count(batches):
    """Each chunk's entries that more documents have, and the levels of their numbers."""
    for bucket, rows in groupby(rows_of(batches), key=lambda r: r[0]):
        rows = list(rows)
        entries = [np.frombuffer(r[2], np.uint32) for r in rows]
        counts = []
        for e, r in zip(entries, rows, strict=True):
            n = np.ones(len(e), np.int64)
            n[np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(e)).astype(bool)] = np.frombuffer(r[4], np.uint32)
            counts.append(n)
        _, of = np.unique(np.concatenate(entries), return_inverse=True)
        total = np.bincount(of, np.concatenate(counts))[of].astype(np.int64)
        at, out = 0, []
        for e, r in zip(entries, rows, strict=True):
            own = total[at : at + len(e)]
            at += len(e)
            if (several := own > 1).any():
                out.append((r[1], bucket, np.packbits(several).tobytes() + np.log2(own[several]).astype(np.uint8).tobytes()))
        yield batch_of(_LEVELS, out)


def _select(n: int, percent: int, bits: int):
    """Rows of kind 0: all documents; of kind 1: sets that may have a link, with the first of their shingles in the common order."""

    def run(batches):
        for _, ids, nulls, offsets, text, answers in rows_of(batches):
            c = Chunk(ids, nulls, offsets, text, n, bits)
            out = [(0, None if null else i, len(s), *p, None, None) for i, null, s, p in zip(c.ids.tolist(), c.nulls.tolist(), c.sets, c.prints, strict=True)]
            for i, level in zip(c.taken, c.levels([(a["bucket"], a["levels"]) for a in answers or ()]), strict=True):
                s = c.sets[i]
                need = -(-percent * len(s) // 100)
                if np.count_nonzero(level) >= need:
                    order = np.argsort(level, kind="stable")
                    firsts = s[order[: len(s) - need + 1]]
                    out.append((1, int(c.ids[i]), len(s), *c.prints[i], s.tobytes(), firsts[level[order[: len(firsts)]] > 0].tobytes()))
            yield batch_of(_SETS, out)

    return run


def _bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).view(np.uint64)


def _bits(n: int) -> int:
    return max(64, 1 << (2 * n - 1).bit_length())


def _links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _passes(differ: np.ndarray | int, both: np.ndarray | int, percent: int):
    """Whether sets of so many shingles in all may link, if their bitmaps differ in so many bits."""
    return (both - differ) // 2 * (100 + percent) >= percent * both


def link(ids: list[int], sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect what the links among these sets connect. Sets with equal ids are one class already. side: pairs
    on one side are looked at only if it is side 0."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    side = None if side is None else np.asarray(side)[order]
    sizes = np.array([len(s) for s in sets])
    _, root = np.unique(np.array(ids), return_inverse=True)  # the class of each set; relabelled as classes join
    low = np.searchsorted(sizes, -(-sizes * percent // 100))
    band = np.floor(np.log(sizes) / math.log(100.001 / percent)).astype(np.int64)
    found = []
    for b in np.unique(band):
        first, last = np.searchsorted(band, b), np.searchsorted(band, b, "right")
        below = np.searchsorted(band, b - 1)
        bits = _bits(int(sizes[last - 1]))
        bitmaps = np.array([_bitmap(s, bits) for s in sets[below:last]])
        for i in range(first, last):
            j = np.arange(low[i], i)
            j = j[root[j] != root[i]]
            if side is not None:
                j = j[(side[j] != side[i]) | (side[j] == 0)]
            if not len(j):
                continue
            differ = np.bitwise_count(bitmaps[j - below] ^ bitmaps[i - below]).sum(axis=1, dtype=np.int64)
            j = j[_passes(differ, sizes[i] + sizes[j], percent)][::-1]
            while len(j):
                k = j[0]
                if _links(sets[i], sets[k], percent):
                    found.append((ids[i], ids[k]))
                    root[root == root[i]] = root[k]
                    j = j[root[j] != root[k]]
                else:
                    j = j[1:]
    return found


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _against_hub(percent: int):
    """Rows (hub, salt, is_hub, id, members), a hub's own before its documents': the edges to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, bitmap = None, np.empty(0, np.uint64), None
        for batch in batches:
            out = []
            for h, _, is_hub, i, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(m, np.uint64)
                if is_hub:
                    hub, own = h, s
                    bits = _bits(len(own))
                    bitmap = _bitmap(own, bits)
                elif h == hub and 100 * min(len(s), len(own)) >= percent * max(len(s), len(own)):
                    differ = int(np.bitwise_count(_bitmap(s, bits) ^ bitmap).sum())
                    if _passes(differ, len(s) + len(own), percent) and _links(s, own, percent):
                        out.append((i, hub))
            if out:
                yield _batch(_EDGE, *zip(*out, strict=True))

    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, firsts) to the smallest and greatest class of each key in a task."""
    schema = pa.schema([("key", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
    keys, labels, n = [], [], 0

    def dealt() -> pa.RecordBatch:
        key, label = np.concatenate(keys), np.concatenate(labels)
        keys.clear(), labels.clear()
        order = np.argsort(key, kind="stable")
        key, label = key[order], label[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return _batch(schema, key[at].view(np.int64), np.minimum.reduceat(label, at), np.maximum.reduceat(label, at))

    for batch in batches:
        for label, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if first:
                keys.append(np.frombuffer(first, np.uint64))
                labels.append(np.full(len(keys[-1]), label, np.int64))
                n += len(keys[-1])
                if n > ROWS:
                    yield dealt()
                    n = 0
    if keys:
        yield dealt()


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, n, firsts) to a row for each key."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        firsts = batch.column(3).to_pylist()
        each = np.array([len(f) // 8 for f in firsts], np.int64)
        key = np.frombuffer(b"".join(firsts), np.int64)
        for at in range(0, len(key), 200_000):
            of = np.repeat(np.arange(len(firsts)), each)[at : at + 200_000]
            yield _batch(schema, key[at : at + 200_000], *(batch.column(i).to_numpy()[of] for i in range(3)))


def _verify(percent: int):
    def edges(group):
        labels, sides, members = zip(*group, strict=True)
        sets, side = [np.frombuffer(m, np.uint64) for m in members], np.array(sides)
        return link(list(labels), sets, percent, side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group = None, []
        for batch in batches:
            out = []
            for t, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != task:
                    out += edges(group) if len(group) > 1 else []
                    task, group = t, []
                group.append(row)
            if out:
                yield _batch(_EDGE, *zip(*out, strict=True))
        if len(group) > 1 and (out := edges(group)):
            yield _batch(_EDGE, *zip(*out, strict=True))

    return run


_KEYS = "key long, id long, label long, n long"


def _families(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between documents and the smallest document of one of their keys."""
    keys = save(sets.select("id", "id", "n", "firsts").toDF("id", "label", "n", "firsts").mapInArrow(_explode, _KEYS).select("key", F.col("id").alias("doc")), "shingle-keys")
    hubs = keys.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).where("hub < last").select("key", "hub")
    pairs = save(keys.join(hubs, "key").where("doc <> hub").select("doc", "hub").distinct(), "shingle-pairs")
    counts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / FAMILY).alias("salts"))
    salted = pairs.join(counts, "hub").select("hub", F.pmod(F.xxhash64("doc"), F.col("salts")).alias("salt"), "doc")
    salted = save(salted, "shingle-pairs")
    members = sets.select(F.col("id").alias("doc"), "members")
    docs = salted.join(members, "doc").select("hub", "salt", F.lit(False).alias("is_hub"), "doc", "members")
    own = counts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).join(members.withColumnRenamed("doc", "hub"), "hub")
    both = docs.unionByName(own.select("hub", "salt", F.lit(True).alias("is_hub"), F.col("hub").alias("doc"), "members"))
    both = both.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.desc("is_hub"))
    found = save(both.mapInArrow(_against_hub(percent), "a long, b long"), "shingle-edges")
    drop(keys), drop(pairs), drop(salted)
    return found


def _labels(sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the sets that have a link."""
    edges = _families(sets, percent)
    first = components(edges)
    drop(edges)
    held = sets.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    held = save(held.select("id", "label", "n", "members", "firsts"), "shingle-sets-by-class")
    open_keys = held.select("label", "firsts").mapInArrow(_classes, "key long, low long, high long").groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("key")
    open_keys = save(open_keys, "shingle-open-keys")
    if open_keys.isEmpty():
        drop(held), drop(open_keys)
        return first
    rows = save(held.select("id", "label", "n", "firsts").mapInArrow(_explode, _KEYS).join(open_keys, "key"), "shingle-open-rows")
    # all have been compared with the smallest document, so that one is no longer looked at
    smallest = rows.groupBy("key").agg(F.min("id").alias("hub"))
    rest = rows.join(smallest, "key").where("id <> hub").drop("hub")
    still = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("id").alias("group")).where("low < high")
    still = save(still.select("key", "group"), "shingle-still-open")
    rest = rest.join(still, "key").select("group", "id", "label", "n").distinct()
    largest = rest.groupBy("group", "label").agg(F.count("*").alias("c")).groupBy("group").agg(F.max(F.struct("c", "label")).alias("m")).select("group", F.col("m.label").alias("largest"))
    rest = save(rest.join(largest, "group").select("group", "id", "n", (F.col("label") == F.col("largest")).alias("main")), "shingle-open-rows")
    tasks = _tiles(rest, percent).join(held.select("id", "label", "members"), "id")
    tasks = tasks.select("task", "label", "side", "members").repartition("task").sortWithinPartitions("task")
    edges = save(tasks.mapInArrow(_verify(percent), "a long, b long"), "shingle-edges")
    second = components(edges)
    drop(edges), drop(held), drop(open_keys), drop(rows), drop(still), drop(rest)
    known = first.unionByName(second.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
    joined = known.join(second.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
    out = save(joined.select("node", F.coalesce("further", "label").alias("label")), "shingle-labels")
    drop(first), drop(second)
    return out


def similar(df: DataFrame, percent: int = 75, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: id, n_shingles, component_id. Ids are integers."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chunks = pack(docs, "shingle-chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = bits_for(total, BUCKET)
    texts = chunks.select("chunk", "ids", "nulls", "offsets", "text")
    with setting(spark, BATCH, "8"):
        sent = texts.mapInArrow(_send_entries(n, bits), _ENTRIES)
        levels = save(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, _LEVELS), "shingle-levels")
        answers = levels.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "levels")).alias("answers")).hint("shuffle_hash")
        found = save(texts.join(answers, "chunk", "left").mapInArrow(_select(n, percent, bits), _SETS), "shingle-sets", ["kind"])
    drop(chunks), drop(levels)
    taken = found.where("kind = 1")
    # equal sets are one from here on: their smallest document
    first = taken.groupBy("p1", "p2", "n").agg(F.min("id").alias("id"))
    sets = save(taken.select("id", "n", "members", "firsts").join(first.select("id"), "id", "left_semi"), "shingle-sets")
    with setting(spark, BATCH, "1000"):
        labels = _labels(sets, percent)
    drop(sets)
    own = found.where("kind = 0").select("id", "n", "p1", "p2")
    # copies of a set share its class; any of them may be the one that took part, and any the smallest
    linked = own.where("n > 0 and id is not null").join(labels.withColumnRenamed("node", "id"), "id", "left")
    first = save(linked.groupBy("p1", "p2", "n").agg(F.min("id").alias("least"), F.min("label").alias("label")), "shingle-classes")
    lowest = save(first.where("label is not null").groupBy("label").agg(F.min("least").alias("lowest")), "shingle-lowest")
    first = first.join(lowest, "label", "left").select("p1", "p2", "n", F.least("label", "lowest", "least").alias("component"))
    first = save(first, "shingle-classes")
    out = own.join(first, ["p1", "p2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _tiles(rows: DataFrame, percent: int) -> DataFrame:
    """rows: (group, id, n, main). (task, side, id): of rows that aren't main, each two tiles of a group in the same or neighbouring size bands are a task; where there is one tile
    of a band and one of the next, the first is compared within itself in the same task. Main rows meet the others of their and both next bands."""
    cost = F.lit(64) + 8 * F.col("n")
    band = F.floor(F.log("n") / F.lit(math.log(100.001 / percent))).cast("int")
    every = rows.withColumn("band", band)
    rows = every.where("not main")
    counts = rows.groupBy("group", "band").agg(F.ceil(F.sum(cost) * 2 / TILE).cast("int").alias("tiles"))
    around = counts.select("group", "tiles", F.explode(F.array(*(F.struct((F.col("band") + k).alias("band"), F.lit(-k).alias("at")) for k in (-1, 0, 1)))).alias("x")).select("group", "x.*", "tiles")
    around = around.groupBy("group", "band").agg(*(F.max(F.when(F.col("at") == k, F.col("tiles"))).alias(c) for k, c in ((-1, "below"), (0, "here"), (1, "above")))).where("here is not null")
    rows = rows.join(around, ["group", "band"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("here")).cast("int"))
    none = F.array().cast("array<struct<b:int,i:int,c:int,j:int,side:int>>")

    def pairs(count: str, make) -> Column:
        return F.when(F.col(count).isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(1)) - 1), make))

    def pair(b, i, c, j, side) -> Column:
        return F.struct(b.cast("int").alias("b"), i.cast("int").alias("i"), c.cast("int").alias("c"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    b, i = F.col("band"), F.col("i")
    both = F.coalesce((F.col("here") == 1) & (F.col("above") == 1), F.lit(False))
    tasks = F.concat(
        F.when(both, none).otherwise(pairs("here", lambda j: pair(b, F.least(i, j), b, F.greatest(i, j), F.when(i == j, 0).when(i < j, 2).otherwise(1)))),
        pairs("above", lambda j: pair(b, i, b + 1, j, F.when(both, 0).otherwise(2))),
        pairs("below", lambda j: pair(b - 1, j, b, i, F.lit(1))),
    )
    tiled = rows.select("group", "id", F.explode(tasks).alias("t"))
    tiled = tiled.select(F.xxhash64("group", "t.b", "t.i", "t.c", "t.j").alias("task"), "id", F.col("t.side").alias("side"))

    # main rows, in tiles of FAMILY rows, with the tiles of the others
    main = every.where("main")
    size = F.greatest(F.ceil(F.sum(cost) * 2 / TILE), F.ceil(F.count("*") / FAMILY)).cast("int")
    tiles = {True: main.groupBy("group", "band").agg(size.alias("tiles")), False: counts}

    def met(own: DataFrame, which: bool) -> DataFrame:
        """Rows with their own tile, and each tile that they meet in the other rows' bands."""
        own = own.join(tiles[which], ["group", "band"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).drop("tiles")
        near = tiles[not which].select("group", F.col("band").alias("other"), "tiles", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band"))
        return own.join(near, ["group", "band"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))

    both = [met(main, True).select("id", F.lit(1).alias("side"), F.xxhash64(F.lit(1), "group", "band", "i", "other", "j").alias("task"))]
    both.append(met(rows, False).select("id", F.lit(2).alias("side"), F.xxhash64(F.lit(1), "group", "other", "j", "band", "i").alias("task")))
    return tiled.unionByName(both[0]).unionByName(both[1])
