"""Operator 7: benchmark decontamination by spaced-seed hashing.

``overlaps`` finds passages of a training table that overlap items of a test table, with some words
substituted:

1. Each fixed mask takes some words of a window and ignores the others. The hash of the words taken is
   a spaced seed; windows that differ in ignored words only have equal seeds. Equal items are one item.
2. A filter of bounded size is made of the test seeds and sent to all tasks. Documents with a seed that may be a test
   seed are written with their words' hashes; all others are read once and give nothing.
3. Their seeds are joined to the test seeds. A document's words and the items that it hits then come to one task,
   in order of item, diagonal and place, so that a task holds one document and one item at a time.
4. Around each hit the overlap is extended both ways while words agree, or while a word that differs is
   followed by enough words that agree. If too few words of all that agree, the longest stretch in it with enough is taken.
   Overlaps of ``least_words`` words, or of ``least_share`` of an item's words if that is less, are kept if ``least_equal``
   of their words agree.

Words are runs of letters, digits and bytes beyond ASCII, with A-Z as a-z. A row of the result is the longest overlap
of a document and an item; n_items is the number of equal items, and item_id the smallest of their ids.

Items of fewer than ``SHORT`` words are matched word for word and whole. Items of fewer than ``least_item`` words match
nothing, as ordinary phrases would be: it may be set to 1. Null and empty texts have no words and no overlaps. Rows with
equal ids are rows of their own, and each gives its overlaps; null ids likewise. An empty table on either side gives no
rows. Further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BATCH
from .hashing import VALUES, mix, parts, words
from .scratch import drop, save, setting

#: Fixed masks: 1 takes the word at that place, 0 ignores it. Each run of 7 words or more that begins and ends with words that agree, of which
#: 3 in 4 agree and at most 2 in any 6 differ, keeps a seed, wherever its substitutions are. Below 3 in 4, or with less than 7 words, it needn't.
MASKS = ("1101011", "11001101", "11111", "10110011", "111101", "1110011", "101111", "1101101")
#: Of so many words in a row two at most differ within an overlap.
WINDOW = 6
#: Items of fewer words are matched whole: the masks need as many.
SHORT = 7
#: Of the filter: bits a seed, most bits, and bits that are looked at.
BITS, MOST_BITS, LOOKS = 64, 1 << 28, 6
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_FOLDED = VALUES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = VALUES[ord("a") : ord("z") + 1]
_TAKEN = [np.flatnonzero([c == "1" for c in mask]) for mask in MASKS]
_ODD = mix(np.arange(100, 164, dtype=np.uint64)) | np.uint64(1)
FOUND = "doc_id long, item_id long, n_items long, n_words long, n_equal long, doc_start long, doc_stop long, item_start long, item_words long"
_ITEMS, _SEEDS = "item_id long, p1 long, p2 long, n long, words binary", "seed long, item long, place long"
_SUSPECTS = "key long, doc_id long, words binary, starts binary, ends binary, seeds binary, at binary"
_ROWS = "key long, item long, diagonal long, at long, doc_id long, item_id long, n_items long, words binary, starts binary, ends binary"
_FIRST = np.iinfo(np.int64).min


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in columns.split(", ")])


def _batch(columns: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = _schema(columns)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def seeds(h: np.ndarray, k: int) -> np.ndarray:
    """Seeds of mask k at every word at which it fits."""
    n = max(0, len(h) - len(MASKS[k]) + 1)
    s = np.zeros(n, np.uint64)
    for j, t in enumerate(_TAKEN[k]):
        s += h[t : t + n] * _ODD[j]
    return mix(s + np.uint64(k))


def whole(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row at every word, for items that are matched whole."""
    m = max(0, len(h) - n + 1)
    s = np.zeros(m, np.uint64)
    for j in range(n):
        s += h[j : j + m] * _ODD[j]
    return mix(s + np.uint64(len(MASKS) + n))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buffer, offsets in parts(batch.column(0), batch.column(1)):
            h, _, _, first = words(buffer, offsets, _IS_WORD, _FOLDED)
            out = []
            for row, a, z in zip(rows.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = h[a:z]
                if len(own):
                    nth = np.arange(len(own), dtype=np.uint64)
                    prints = (mix(own + mix(nth + np.uint64(c))).sum().astype(np.int64) for c in (1, 1 << 20))
                    out.append((batch.column(0)[row].as_py(), *map(int, prints), len(own), own.tobytes()))
            yield _batch(_ITEMS, out)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = np.frombuffer(own, np.uint64)
            found = [whole(h, len(h))] if len(h) < SHORT else [seeds(h, k) for k in range(len(MASKS))]
            seed, place = np.concatenate(found), np.concatenate([np.arange(len(s)) for s in found])
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(np.full(len(seed), item)), pa.array(place)], schema=_schema(_SEEDS))


def _places(seed: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of the filter that stand for these seeds, one look after the other."""
    for i in range(LOOKS):
        yield mix(seed + np.uint64(i + 1)) & np.uint64(bits - 1)


def _filter_of(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        held = held.view(np.int64)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["at", "bits"])

    return run


def passing(seed: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of these seeds the filter lets through: all test seeds and few others."""
    at = np.arange(len(seed))
    for i in range(LOOKS):
        place = mix(seed[at] + np.uint64(i + 1)) & np.uint64(len(held) * 8 - 1)
        at = at[(held[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def _suspects(held, lengths: list[int]):
    """Documents with a seed that passes. lengths: those of items that are matched whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows, buffer, offsets in parts(batch.column(0), batch.column(1)):
                h, starts, ends, first = words(buffer, offsets, _IS_WORD, _FOLDED)
                seed, place = [], []
                for f, size in [*((lambda h, k=k: seeds(h, k), len(mask)) for k, mask in enumerate(MASKS)), *((lambda h, n=n: whole(h, n), n) for n in lengths)]:
                    s = f(h)
                    at = passing(s, held.value)
                    at = at[at + size <= first[np.searchsorted(first, at, "right")]] if len(at) else at  # within one text
                    seed.append(s[at]), place.append(at)
                seed, place = np.concatenate(seed), np.concatenate(place)
                order = np.argsort(place, kind="stable")
                seed, place = seed[order], place[order]
                cut = np.searchsorted(place, first)
                out = []
                for d in np.flatnonzero(np.diff(cut)).tolist():
                    a, z, w = cut[d], cut[d + 1], slice(first[d], first[d + 1])
                    at = [(x - offsets[d]).astype(np.int64).tobytes() for x in (starts[w], ends[w])]
                    out.append((key, batch.column(0)[int(rows[d])].as_py(), h[w].tobytes(), *at, seed[a:z].tobytes(), (place[a:z] - first[d]).astype(np.int64).tobytes()))
                    key += 1
                yield _batch(_SUSPECTS, out)

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seeds, at) to a row for each seed."""
    for batch in batches:
        for key, seed, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seed, at = np.frombuffer(seed, np.int64), np.frombuffer(at, np.int64)
            for a in range(0, len(seed), 100_000):
                s = seed[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), key)), pa.array(at[a : a + 100_000])], names=["seed", "key", "at"])


def _reach(a: np.ndarray, b: np.ndarray, window: int = WINDOW, errors: int = 2) -> tuple[int, int]:
    """How far two word sequences agree from their starts, and in how many words: no window has more errors. It ends with a word that agrees."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    equal = a[:n] == b[:n]
    differ = np.cumsum(~equal)
    late = differ - np.concatenate((np.zeros(min(window, n), differ.dtype), differ[: max(0, n - window)]))
    stop = np.flatnonzero(late > errors)
    to = int(stop[0]) if len(stop) else n
    ends = np.flatnonzero(equal[:to])
    to = int(ends[-1]) + 1 if len(ends) else 0
    return to, int(equal[:to].sum())


def _longest(equal: np.ndarray, share: float) -> tuple[int, int]:
    """Start and stop of the longest stretch that begins and ends with a word that agrees and of whose words share agree."""
    over = np.concatenate(([0.0], np.cumsum(equal - share)))
    least = np.minimum.accumulate(np.where(equal, over[:-1], np.inf))  # over the starts up to here
    ends = np.flatnonzero(equal)
    starts = np.searchsorted(-least, -(over[ends + 1] + 1e-9))  # the first that is low enough
    best = int(np.argmax(ends - starts))
    return int(starts[best]), int(ends[best]) + 1


class Pair:
    """The longest overlap of a document's and an item's words, by hits in order of diagonal and place."""

    def __init__(self, item: np.ndarray, least_words: int, least_share: float, least_equal: float):
        self.item, self.least, self.share = item, min(least_words, least_share * len(item)), least_equal
        self.best: tuple[int, int, int, int] | None = None  # words, equal words, start in the document, start in the item
        self.diagonal, self.done = None, -1

    def hit(self, h: np.ndarray, diagonal: int, at: int) -> None:
        """A seed of the document at word at is one of the item at word diagonal + at."""
        if diagonal != self.diagonal:
            self.diagonal, self.done = diagonal, -1
        whole_ = len(self.item) < SHORT
        if self.done >= at + (0 if whole_ else WINDOW):  # a whole window further: the look from here would end at the same word
            return
        place = at + diagonal
        if whole_:
            n = len(self.item)
            if place == 0 and np.array_equal(h[at : at + n], self.item) and self.best is None:
                self.best = n, n, at, 0
            return
        ahead, n_ahead = _reach(h[at : at + len(self.item) - place], self.item[place:])
        back, n_back = _reach(h[max(0, at - place) : at][::-1], self.item[:place][::-1])
        self.done = max(at + ahead, self.done)
        n, equal, start = ahead + back, n_ahead + n_back, at - back
        if 0 < equal < self.share * n:
            same = h[start : start + n] == self.item[place - back : place + ahead]
            skipped, stop = _longest(same, self.share)
            n, equal, start = stop - skipped, int(same[skipped:stop].sum()), start + skipped
        if n >= self.least and equal >= self.share * n and (self.best is None or (n, -start) > (self.best[0], -self.best[2])):
            self.best = n, equal, start, place - at + start


def _verify(options: tuple):
    """Rows of _ROWS in order: a document, then each item that it hits, followed by the hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = pair = None
        out: list[tuple] = []

        def ended() -> None:
            if pair and pair.best:
                n, equal, start, item_start = pair.best
                h, starts, ends, doc_id = doc
                out.append((doc_id, *of, n, equal, int(starts[start]), int(ends[start + n - 1]), item_start, len(pair.item)))

        for batch in batches:
            keys, items, diagonals, ats = (batch.column(i).to_numpy() for i in range(4))
            for i, (item, diagonal, at) in enumerate(zip(items.tolist(), diagonals.tolist(), ats.tolist(), strict=True)):
                if diagonal != _FIRST:
                    pair.hit(doc[0], diagonal, at)
                    continue
                ended()
                own = np.frombuffer(batch.column(7)[i].as_py(), np.uint64)
                if item < 0:
                    doc, pair = (own, *(np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in (8, 9)), batch.column(4)[i].as_py()), None
                else:
                    pair, of = Pair(own, *options), (batch.column(5)[i].as_py(), batch.column(6)[i].as_py())
            if out:
                yield _batch(FOUND, out)
                out.clear()
        ended()
        yield _batch(FOUND, out)

    return run


def overlaps(df: DataFrame, test: DataFrame, least_words: int = 13, least_share: float = 0.8, least_equal: float = 0.75, least_item: int = 5, id_col: str = "doc_id", text_col: str = "text", test_id_col: str = "item_id", test_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_items, n_words, n_equal, doc_start, doc_stop, item_start, item_words): doc_start to doc_stop are bytes of the text."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = test.select(F.col(f"`{test_id_col}`").cast("long").alias("id"), F.col(f"`{test_text_col}`").alias("text"))
    items = rows.mapInArrow(_item_words, _ITEMS).where(F.col("n") >= least_item).groupBy("p1", "p2", "n").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"), F.min("words").alias("words"))
    items = save(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "n_items", "n", "words"), "benchmark-items")
    tested = save(items.select("item", "words").mapInArrow(_item_seeds, _SEEDS), "benchmark-seeds")
    lengths = [r.n for r in items.where(F.col("n") < SHORT).select("n").distinct().collect()]  # SHORT at most
    bits = min(MOST_BITS, max(1 << 10, 1 << (tested.count() * BITS - 1).bit_length()))
    found = tested.select("seed").mapInArrow(_filter_of(bits), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[found["at"].to_numpy()] = found["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(held.view(np.uint8))  # MOST_BITS at most
    with setting(spark, BATCH, "1000"):
        suspects = save(docs.mapInArrow(_suspects(sent, lengths), _SUSPECTS), "benchmark-suspects")
        hits = suspects.select("key", "seeds", "at").mapInArrow(_explode, "seed long, key long, at long").join(tested, "seed")
        hits = save(hits.select("key", "item", (F.col("place") - F.col("at")).alias("diagonal"), "at").distinct(), "benchmark-hits")
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        pairs = hits.select("key", "item").distinct().join(items, "item")
        first = F.lit(_FIRST).alias("diagonal")
        no_at = F.lit(0).cast("long").alias("at")
        both = hits.select("key", "item", "diagonal", "at", none("doc_id", "long"), none("item_id", "long"), none("n_items", "long"), none("words", "binary"), none("starts", "binary"), none("ends", "binary"))
        both = both.unionByName(pairs.select("key", "item", first, no_at, none("doc_id", "long"), "item_id", "n_items", "words", none("starts", "binary"), none("ends", "binary")))
        hit = suspects.join(hits.select("key").distinct(), "key", "left_semi")
        both = both.unionByName(hit.select("key", F.lit(-1).cast("long").alias("item"), first, no_at, "doc_id", none("item_id", "long"), none("n_items", "long"), "words", "starts", "ends"))
        ordered = both.repartition("key").sortWithinPartitions("key", "item", "diagonal", "at")
        out = save(ordered.mapInArrow(_verify((least_words, least_share, least_equal)), FOUND), "benchmark-overlaps")
    for t in (items, tested, suspects, hits):
        drop(t)
    return out.withColumnRenamed("doc_id", id_col).withColumnRenamed("item_id", test_id_col)


def clean(df: DataFrame, test: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of df without an overlap with an item of test. Rows are judged one by one, whatever their ids."""
    row = "_row"
    while row in df.columns:
        row += "_"
    rows = save(df.withColumn(row, F.monotonically_increasing_id()), "rows-with-numbers")
    found = overlaps(rows, test, id_col=row, text_col=text_col, **options)
    return rows.join(found.select(row).distinct(), row, "left_anti").select(*(f"`{c}`" for c in df.columns))
