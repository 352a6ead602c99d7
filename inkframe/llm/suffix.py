"""Operator 1: removal of byte strings that repeat across documents, by a hash-compared suffix sort.

``dedup`` removes each byte that is covered by a string of ``length`` bytes which also starts in a
document with a smaller id. Strings are judged on the input; matches never cross documents.

1. *Seeds.* Each string of ``length`` bytes has a seed: the one of its ``k``-byte strings with the smallest
   hash (the leftmost, if equal). Equal strings have equal seeds at equal places, so it is enough to compare
   strings that share a seed; a seed stands for a run of strings that start one after the other.
2. *Candidates.* Documents are packed into chunks of some megabytes. Each chunk sends the distinct hashes of
   its seeds to the bucket of their leading bits, and how many different texts they stand in; a seed that is in two
   documents is a candidate there, and one that stands in very many texts is a hot one. The answer is two bits for each seed.
3. *Suffix sort.* Each chunk sends the text around its candidates, equal ones once, with the smallest id, to the seed's
   bucket. The strings of a hot seed are sent one by one, each to the bucket of its own hash: so the texts around a frequent
   phrase are spread, and what is the same everywhere is sent once a chunk. A bucket is sorted a slice of hashes at a time.
   The suffixes that start at each string of a seed are sorted by mergesort. Two suffixes are
   compared by prefix polynomial hashes: a binary search for the longest common extension takes about
   log(length) steps, and then one byte decides. Neighbours with a common extension of ``length`` are equal;
   their bytes are compared once more, so that no hash collision removes anything.
4. *Removal.* The answers, a mask for each candidate, go back to the chunks.

Everything that is shuffled has been made distinct within its chunk, so that a passage or copy that fills
the table sends a row a chunk.

Null text: empty. Texts shorter than ``length`` are kept. Null ids have no order: such rows are kept whole
and make no other row lose anything. Rows with the same id never count against each other. Repeated rows
are rows of their own. Further columns are dropped unless the caller keeps them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import BATCH, batch_of, bits_for, pack, rows_of, runs
from .hashing import mix, powers, prefix_hashes
from .scratch import save, setting

#: Bytes of text in a bucket, and the bits of a hash that cut a bucket into slices that are sorted together.
BUCKET, SLICES = 8_000_000, 5
#: A seed in more different texts than this is hot.
HOT = 4_096
_LOW, _NONE = np.uint64(0xFFFFFFFF), np.uint32(0xFFFFFFFF)
#: Bytes whose hashes are made together, so that they stay in a processor's cache, and those whose seeds are cut out together.
_STEP, _PART = 32_768, 64 * 32_768
#: Odd multipliers of the seeds' hashes.
_ODD = np.random.default_rng(50).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seed_size(length: int) -> int:
    """A multiple of 8, of about half the length; a seed then stands for 64 strings at most."""
    return max(8, length // 2 // 8 * 8, -(-(length - 63) // 8) * 8)


def _seed_hashes(text: np.ndarray, at: slice | np.ndarray, k: int) -> np.ndarray:
    """Of the k bytes from each of these places on."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each byte on
    h = eight[at] * _ODD[0]
    for j in range(1, k // 8):
        h += eight[8 * j :][at] * _ODD[j]
    h ^= h >> np.uint64(32)
    h *= _ODD[-1]
    return h


def seeds(text: np.ndarray, offsets: np.ndarray, nulls: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each seed: its place, the first and last start of its strings, its hash and its document's number."""
    k = seed_size(length)
    w, n = length - k + 1, max(0, len(text) - length + 1)
    found = [np.empty((3, 0), np.int64)]
    for begin in range(0, n, _PART):
        end = min(n, begin + _PART)
        place = np.full(end - begin + 1, _NONE, np.uint32)  # of the seed of the string at each byte
        for a in range(begin, end, _STEP):
            z = min(end, a + _STEP)
            least = _seed_hashes(text[a : z + length - 1], slice(0, z - a + w - 1), k) & ~_LOW
            least |= np.arange(a, a + len(least), dtype=np.uint64)
            size = 1
            while 2 * size <= w:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            place[a - begin : z - begin] = (np.minimum(least[: size - w], least[w - size :]) if size < w else least) & _LOW
        for i in range(int(np.searchsorted(offsets, begin, "right")) - 1, int(np.searchsorted(offsets, end))):  # strings that would cross an end
            a, z = int(offsets[i]), int(offsets[i + 1])
            place[max(0, (a if nulls[i] else max(a, z - length + 1)) - begin) : max(0, min(z, end) - begin)] = _NONE
        at = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        stop = np.append(at[1:], end - begin + 1) - 1
        kept = place[at] != _NONE
        found.append(np.stack((place[at[kept]].astype(np.int64), at[kept] + begin, stop[kept] + begin)))
    place, first, last = np.concatenate(found, axis=1)
    # seeds have small hashes, as they are the smallest of many: mixed once more, they fill all buckets alike
    return place, first, last, mix(_seed_hashes(text, place, k)), np.searchsorted(offsets, place, "right") - 1


class Chunk:
    """The documents of a chunk with what every step needs of them."""

    def __init__(self, ids: bytes, nulls: bytes, offsets: bytes, text: bytes, length: int, bits: int):
        self.ids, self.nulls, self.offsets = np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool), np.frombuffer(offsets, np.int64)
        self.text, self.length = np.frombuffer(text, np.uint8), length
        self.place, self.first, self.last, self.hash, doc = seeds(self.text, self.offsets, self.nulls, length)
        self.id = self.ids[doc]
        # distinct leading bits of the hashes: bits for the bucket and 32 more
        entry = self.hash >> np.uint64(32 - bits)
        order = np.argsort(entry)
        entry = entry[order]
        new = np.ones(len(entry), bool)
        new[1:] = entry[1:] != entry[:-1]
        self.of = np.empty(len(entry), np.int64)
        self.of[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.entry, ids_ = entry[at], self.id[order]
        self.several = np.minimum.reduceat(ids_, at) != np.maximum.reduceat(ids_, at) if len(at) else np.empty(0, bool)
        self.buckets = runs(self.entry >> np.uint64(32))

    def contexts(self) -> np.ndarray:
        """In how many different texts each seed stands, by size and both ends."""
        if not len(self.entry):
            return np.empty(0, np.int64)
        eight = np.ndarray((max(0, len(self.text) - 7),), "<u8", self.text, strides=(1,))
        key = mix(eight[self.first] * _ODD[1] + eight[self.last + self.length - 8] * _ODD[2] + (self.last - self.first + 256 * (self.place - self.first)).astype(np.uint64))
        order = np.lexsort((key, self.of))
        of, key = self.of[order], key[order]
        return np.bincount(of[np.concatenate(([True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])))])

    def candidates(self, answers: list[tuple[int, bytes]]) -> None:
        """Keeps the seeds that answers mark, hot ones a string at a time, and finds those with equal text around them."""
        marked, hot = np.zeros(len(self.entry), bool), np.zeros(len(self.entry), bool)
        for b, bits in answers:
            a, z = self.buckets[b]
            both = np.frombuffer(bits, np.uint8).reshape(2, -1)
            marked[a:z], hot[a:z] = np.unpackbits(both[0], count=z - a), np.unpackbits(both[1], count=z - a)
        kept = np.flatnonzero(marked[self.of])
        hot = hot[self.of[kept]]
        n = np.where(hot, self.last[kept] - self.first[kept] + 1, 1)
        of = np.repeat(np.arange(len(kept)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        kept, hot = kept[of], hot[of]
        self.place, self.id, self.hash = self.place[kept], self.id[kept], self.hash[kept]
        self.first = self.first[kept] + nth
        self.last = np.where(hot, self.first, self.last[kept])
        own = self.first[hot]
        key = np.zeros(len(own), np.uint64)
        for j, word in enumerate(_eights(self.text, own, np.full(len(own), self.length))):
            key += word * _ODD[j % 60]
            key ^= key >> np.uint64(29)
        self.hash[hot] = mix(key)
        self.size = self.last - self.first + self.length
        self.same = classes(self.text, self.first, self.size, self.place - self.first, self.id)
        self.heads = np.flatnonzero(self.same == np.arange(len(kept)))


def _eights(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Each range of 8 bytes at least, as 8-byte words that cover it: the last ones overlap."""
    words = np.ndarray((max(0, len(text) - 7),), "<u8", text, strides=(1,))
    for j in range(0, int(np.max(size, initial=0)), 8):
        yield words[start + np.minimum(j, size - 8)]


def classes(text: np.ndarray, start: np.ndarray, size: np.ndarray, seed_at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each range, the number of the one with the smallest id among those with the same bytes and the seed at the same place."""
    if not len(start):
        return np.empty(0, np.int64)
    key = (size * 256 + seed_at).astype(np.uint64)
    for j, word in enumerate(_eights(text, start, size)):
        key += word * _ODD[j % 60]
        key ^= key >> np.uint64(29)
    key = mix(key)
    while True:
        head = _heads(key, ids)
        i = np.flatnonzero(head != np.arange(len(head)))
        same = size[i] == size[head[i]]
        for x, y in zip(_eights(text, start[i], size[i]), _eights(text, start[head[i]], size[head[i]]), strict=False):
            same &= x == y
        if same.all():
            return head
        key[i[~same]] = mix(key[i[~same]] + i[~same].astype(np.uint64))  # collisions: classes of their own


def _heads(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    order = np.lexsort((ids, key))
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    head = np.empty(len(key), np.int64)
    head[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return head


class Suffixes:
    """Compares suffixes of a text by their prefix hashes, as far as ``length`` bytes."""

    def __init__(self, text: np.ndarray, length: int):
        self.text, self.length, self.p, self.down = text, length, prefix_hashes(text), powers(len(text) + 1)[1]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The longest common extension of each two suffixes: a binary search over prefix hashes."""
        n = np.zeros(len(x), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            ok = n + step <= self.length
            a, b = np.where(ok, x + n, 0), np.where(ok, y + n, 0)
            e = np.where(ok, step, 0)
            ok &= (self.p[a + e] - self.p[a]) * self.down[a] == (self.p[b + e] - self.p[b]) * self.down[b]
            n[ok] += step
            step >>= 1
        return n

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        more = n < self.length
        a, b = self.text[np.where(more, x + n, 0)].astype(np.int16), self.text[np.where(more, y + n, 0)].astype(np.int16)
        return np.where(more, a - b, 0)

    def sort(self, cell: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The order of suffixes by cell and then by text: mergesort of all cells at once. Each element's place in the
        merged run is its place in its own run and the number of elements of the other run that go before it."""
        order = np.argsort(cell, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = cell[order][1:] != cell[order][:-1]
        base = np.flatnonzero(new)[np.cumsum(new) - 1]
        size = np.diff(np.flatnonzero(new), append=len(order))[np.cumsum(new) - 1]
        run = 1
        while len(at := np.flatnonzero(size > run)):
            b, end = base[at], base[at] + size[at]
            nth = (at - b) // run
            low = np.minimum(b + (nth ^ 1) * run, end)
            high, other, x, after = np.minimum(low + run, end), low.copy(), start[order[at]], nth % 2 == 1
            while len(left := np.flatnonzero(low < high)):
                mid = (low[left] + high[left]) // 2
                sign = self.compare(start[order[mid]], x[left])
                goes = (sign < 0) | ((sign == 0) & after[left])
                low[left[goes]] = mid[goes] + 1
                high[left[~goes]] = mid[~goes]
            to = b + (nth & ~1) * run + (at - b - nth * run) + (low - other)
            moved = order.copy()
            moved[to] = order[at]
            order, run = moved, run * 2
        return order

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether both suffixes have ``length`` bytes in common, by hash and then by their bytes."""
        same = self.common(x, y) >= self.length
        at = np.flatnonzero(same)
        for a in range(0, len(at), 100_000):
            i = at[a : a + 100_000]
            n = np.full(len(i), self.length)
            for a_, b_ in zip(_eights(self.text, x[i], n), _eights(self.text, y[i], n), strict=True):
                same[i] &= a_ == b_
        return same


def covered(text: np.ndarray, size: np.ndarray, seed_at: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For the texts around seeds, one after the other in text: a mask of the strings that have a smaller id elsewhere."""
    start = np.cumsum(size) - size
    head = classes(text, start, size, seed_at, ids)
    strings = size - length + 1
    mask = np.zeros(len(size), np.uint64)
    r = np.flatnonzero(head == np.arange(len(head)))
    _, group, n = np.unique(_seed_hashes(text, (start + seed_at)[r], seed_size(length)), return_inverse=True, return_counts=True)
    keep = n[group] > 1
    r, group = r[keep], group[keep]
    if len(r):
        of = np.repeat(np.arange(len(r)), strings[r])
        j = np.arange(len(of)) - np.repeat(np.cumsum(strings[r]) - strings[r], strings[r])
        own_size = size[r]
        own_start = np.cumsum(own_size) - own_size
        suffix = own_start[of] + j
        cell = group[of] * 64 + seed_at[r][of] - j
        s = Suffixes(text[np.repeat(start[r] - own_start, own_size) + np.arange(own_size.sum())], length)
        order = s.sort(cell, suffix)
        new = np.ones(len(order), bool)
        same_cell = np.flatnonzero(cell[order][1:] == cell[order][:-1])
        new[same_cell + 1] = ~s.equal(suffix[order[same_cell]], suffix[order[same_cell + 1]])
        at = np.flatnonzero(new)
        own = ids[r][of][order]
        lost = own > np.minimum.reduceat(own, at)[np.cumsum(new) - 1]
        np.bitwise_or.at(mask, r[of[order[lost]]], np.uint64(1) << j[order[lost]].astype(np.uint64))
    every = ~np.uint64(0) >> (64 - strings).astype(np.uint64)
    return np.where(ids > ids[head], every, mask[head])


# the steps, as functions of Arrow batches


_SEEDS, _MARKS = "bucket long, chunk long, entries binary, several binary, contexts binary", "chunk long, bucket long, bits binary"


def _send_seeds(length: int, bits: int):
    def run(batches):
        for chunk, ids, nulls, offsets, text in rows_of(batches):
            c = Chunk(ids, nulls, offsets, text, length, bits)
            low, n = (c.entry & _LOW).astype(np.uint32), c.contexts()
            more = n > 1
            yield batch_of(_SEEDS, [(b, chunk, low[a:z].tobytes(), np.packbits(c.several[a:z]).tobytes(), np.packbits(more[a:z]).tobytes() + n[a:z][more[a:z]].astype(np.uint32).tobytes()) for b, (a, z) in c.buckets.items()])

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in groupby(rows_of(batches), key=lambda r: r[0]):
        rows = list(rows)
        entries = [np.frombuffer(r[2], np.uint32) for r in rows]
        several = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(e)) for r, e in zip(rows, entries, strict=True)]).astype(bool)
        _, of, n = np.unique(np.concatenate(entries), return_inverse=True, return_counts=True)
        texts = []
        for r, e in zip(rows, entries, strict=True):
            own, size = np.ones(len(e), np.int64), -(-len(e) // 8)
            own[np.unpackbits(np.frombuffer(r[4], np.uint8, size), count=len(e)).astype(bool)] = np.frombuffer(r[4][size:], np.uint32)
            texts.append(own)
        hot = (np.bincount(of, np.concatenate(texts)) > HOT)[of]
        n[of[several]] += 1
        marked, at, out = n[of] > 1, 0, []
        for r, e in zip(rows, entries, strict=True):
            if (bits := marked[at : at + len(e)]).any():
                out.append((r[1], bucket, np.packbits(bits).tobytes() + np.packbits(hot[at : at + len(e)]).tobytes()))
            at += len(e)
        yield batch_of(_MARKS, out)


_AROUND, _MASKS = "bucket long, chunk long, n int, around binary", "chunk long, bucket long, bits binary, nth binary"


def _send_text(length: int, bits: int):
    def run(batches):
        for chunk, ids, nulls, offsets, text, marks in rows_of(batches):
            c = Chunk(ids, nulls, offsets, text, length, bits)
            c.candidates([(m["bucket"], m["bits"]) for m in marks])
            h = c.heads
            if not len(h):
                continue
            zstd = zstandard.ZstdCompressor(level=1)
            bucket = (c.hash[h] >> np.uint64(64 - bits)).astype(np.int64)
            part = (c.hash[h] >> np.uint64(64 - bits - SLICES)).astype(np.uint8) & np.uint8((1 << SLICES) - 1)
            order = np.argsort(bucket, kind="stable")
            cut = [*np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist(), len(order)]
            i = h[order]
            size = c.size[i]
            ends = np.concatenate(([0], np.cumsum(size)))
            around = c.text[np.repeat(c.first[i] - ends[:-1], size) + np.arange(ends[-1])]
            columns = [c.id[i], order.astype(np.int32), size.astype(np.uint16), (c.place - c.first)[i].astype(np.uint8), part[order]]
            out = []
            for a, z in zip(cut, cut[1:]):
                sent = b"".join([*(x[a:z].tobytes() for x in columns), around[ends[a] : ends[z]].tobytes()])
                out.append((int(bucket[order[a]]), chunk, z - a, zstd.compress(sent)))
            yield batch_of(_AROUND, out)

    return run


def _sort(length: int):
    def run(batches):
        for bucket, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            rows = list(rows)
            columns = []
            for _, _, n, around in rows:
                around = zstandard.decompress(around)
                columns.append([np.frombuffer(around, kind, -1 if i == 5 else n, at * n) for i, (kind, at) in enumerate(((np.int64, 0), (np.int32, 8), (np.uint16, 12), (np.uint8, 14), (np.uint8, 15), (np.uint8, 16)))])
            ids, nth, size, seed_at, part, text = (np.concatenate(x) for x in zip(*columns, strict=True))
            del columns, around
            size, seed_at = size.astype(np.int64), seed_at.astype(np.int64)
            start, mask = np.cumsum(size) - size, np.zeros(len(ids), np.uint64)
            for p in range(1 << SLICES):
                i = np.flatnonzero(part == p)
                ends = np.concatenate(([0], np.cumsum(size[i])))
                own = text[np.repeat(start[i] - ends[:-1], size[i]) + np.arange(ends[-1])]
                mask[i] = covered(own, size[i], seed_at[i], ids[i], length)
            at, out = 0, []
            for _, chunk, n, _ in rows:
                s = slice(at, at + n)
                at += n
                found = np.flatnonzero(mask[s])
                if len(found):
                    out.append((chunk, bucket, mask[s][found].tobytes(), nth[s][found].tobytes()))
            yield batch_of(_MASKS, out)

    return run


def cover(c: Chunk, masks: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Which bytes of a chunk are removed."""
    mask = np.zeros(len(c.heads), np.uint64)
    for nth, bits in masks:
        mask[np.frombuffer(nth, np.int32)] = np.frombuffer(bits, np.uint64)
    full = np.flatnonzero(c.id > c.id[c.same])
    edge = np.zeros(len(c.text) + 1, np.int32)
    np.add.at(edge, c.first[full], 1)
    np.add.at(edge, c.last[full] + c.length, -1)
    number = np.zeros(len(c.same), np.int64)
    number[c.heads] = np.arange(len(c.heads))
    own = mask[number[c.same]]
    own[full] = 0
    for j in range(int((c.last - c.first).max(initial=-1)) + 1):
        at = c.first[np.flatnonzero((own >> np.uint64(j)) & np.uint64(1))] + j
        np.add.at(edge, at, 1)
        np.add.at(edge, at + c.length, -1)
    return np.cumsum(edge[:-1]) > 0


_RESULT = "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,stop:bigint>>, kept binary"


def _whole_characters(gone: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keeps UTF-8 characters of which some bytes are kept."""
    starts = np.flatnonzero(text & 0xC0 != 0x80)
    if not len(starts):
        return gone
    every = np.logical_and.reduceat(gone, starts)
    return np.repeat(every, np.diff(starts, append=len(text)))


def _remove(length: int, bits: int, whole: bool):
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])
    columns = list(schema)

    def run(batches):
        for _, ids, nulls, offsets, text, others, marks in rows_of(batches):
            if marks:
                c = Chunk(ids, nulls, offsets, text, length, bits)
                c.candidates([(m["bucket"], m["bits"]) for m in marks if m["nth"] is None])
                gone = cover(c, [(m["nth"], m["bits"]) for m in marks if m["nth"] is not None])
                gone = _whole_characters(gone, c.text) if whole else gone
            else:
                gone = np.zeros(len(text), bool)
            offsets, text = np.frombuffer(offsets, np.int64), np.frombuffer(text, np.uint8)
            removed = np.concatenate(([0], np.cumsum(gone)))
            first, last = gone.copy(), gone.copy()
            first[1:] &= ~gone[:-1]
            last[:-1] &= ~gone[1:]
            inner = offsets[(offsets > 0) & (offsets < len(gone))]
            first[inner], last[inner - 1] = gone[inner], gone[inner - 1]
            starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
            cut = np.searchsorted(starts, offsets)
            at = np.repeat(offsets[:-1], np.diff(cut))
            kept = offsets - removed[offsets]
            spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - at), pa.array(stops - at)], fields=list(span)))
            bytes_ = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(text[~gone])])
            n = [np.diff(offsets), np.diff(removed[offsets]), np.diff(cut)]
            others = pa.ipc.open_stream(others).read_all().combine_chunks().to_batches()
            others = others[0] if others else None
            arrays = [pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(nulls, bool)), *(pa.array(x, pa.int64()) for x in n), spans, bytes_, *(others.columns if others else ())]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*columns, *(others.schema if others else ())]))

    return run


def dedup(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each row of df: id, n_bytes, n_removed, n_spans, spans (byte ranges that are removed) and kept (the other bytes).
    With whole_characters, characters at the edges of spans stay whole, so that what is kept is UTF-8. keep: further columns that stay."""
    if length < 16:
        raise ValueError("strings of 16 bytes at least")
    spark = df.sparkSession
    # further columns travel under names of their own
    others = [F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)]
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), *others)
    chunks = pack(docs, "suffix-chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = bits_for(total, BUCKET)
    by_bucket = lambda sent, f, columns: sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(f, columns)
    with setting(spark, BATCH, "8"):
        marks = save(by_bucket(chunks.select("chunk", "ids", "nulls", "offsets", "text").mapInArrow(_send_seeds(length, bits), _SEEDS), _mark, _MARKS), "suffix-marks")
        asked = marks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks")).hint("shuffle_hash")
        sent = chunks.select("chunk", "ids", "nulls", "offsets", "text").join(asked, "chunk").mapInArrow(_send_text(length, bits), _AROUND)
        masks = save(by_bucket(sent, _sort(length), _MASKS), "suffix-masks")
    answers = marks.withColumn("nth", F.lit(None).cast("binary")).unionByName(masks)
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits", "nth")).alias("marks")).hint("shuffle_hash")
    fields = T._parse_datatype_string(_RESULT).fields + docs.schema.fields[2:]
    out = chunks.drop("n_bytes").join(answers, "chunk", "left").mapInArrow(_remove(length, bits, whole_characters), T.StructType(fields))
    return out.toDF(id_col, *(f.name for f in fields[1 : -len(keep) or None]), *keep)
