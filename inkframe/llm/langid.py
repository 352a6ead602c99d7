"""Operator 2: language identification of mixed-language text.

``train`` counts, over all labelled rows, the character trigrams of words and the scripts of letters by
language. Words are runs of letters and combining marks with a letter in them. ``predict`` gives each word of a whole text a score for each language: the sum of the
logarithms of its trigrams' probabilities. The script of a word (a table of code point ranges) narrows the
candidates to the languages that use it. Viterbi's algorithm over the words, with a penalty for each
switch of language, then labels spans; the language with the most letters is the text's. Its score is the share of
all letters that are in its spans, in words of a script that a learned language uses: a text in a script that was never
learned gets the likeliest language, with score 0.

The model has a fixed number of counts for each language, so its size depends on the number of languages
only. Viterbi's recursion runs over all texts of a batch at once; long texts are cut into stretches whose best
paths between each two languages are found side by side and then chained, which is exact.

Null text and text without a letter: ``und``, score 0, no spans. Rows with null labels are not learned from.
With nothing learned every text is ``und``. Ties go to the first language in order. Words have no length
limit. Repeated rows and ids that are null or equal are rows of their own. Columns of the names that ``predict`` adds are
replaced; all others stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of trigram counts of a language.
SLOTS = 1 << 16
#: Scripts as (name, first and last code point of each range): fixed values of the Unicode standard.
SCRIPTS = [
    ("latin", (0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)),
    ("greek", (0x370, 0x3FF), (0x1F00, 0x1FFF)),
    ("cyrillic", (0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)),
    ("armenian", (0x530, 0x58F)),
    ("hebrew", (0x590, 0x5FF)),
    ("arabic", (0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    ("devanagari", (0x900, 0x97F)),
    ("bengali", (0x980, 0x9FF)),
    ("gurmukhi", (0xA00, 0xA7F)),
    ("gujarati", (0xA80, 0xAFF)),
    ("tamil", (0xB80, 0xBFF)),
    ("telugu", (0xC00, 0xC7F)),
    ("kannada", (0xC80, 0xCFF)),
    ("malayalam", (0xD00, 0xD7F)),
    ("sinhala", (0xD80, 0xDFF)),
    ("thai", (0xE00, 0xE7F)),
    ("lao", (0xE80, 0xEFF)),
    ("tibetan", (0xF00, 0xFFF)),
    ("burmese", (0x1000, 0x109F)),
    ("georgian", (0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    ("hangul", (0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    ("ethiopic", (0x1200, 0x139F)),
    ("khmer", (0x1780, 0x17FF)),
    ("kana", (0x3040, 0x30FF), (0xFF66, 0xFF9F)),
    ("han", (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
]
#: A language uses a script if so much of its letters are in it.
USES = 0.002
#: Characters of texts that are looked at together, and words of a stretch.
PART, STRETCH = 3_000_000, 256
UNKNOWN = "und"
#: More labels than this aren't languages: the model's size would have no bound.
MOST_LABELS = 1_000


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # (language, slot): log probabilities
    uses: np.ndarray  # (language, script)


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, whether a combining mark, its lower case, its script (0: another)."""
    letter = np.array([chr(i).isalpha() for i in range(0x110000)])
    mark = np.array([unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)])
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        if len(c := chr(i).lower()) == 1:
            lower[i] = ord(c)
    script = np.zeros(0x110000, np.uint8)
    for k, (_, *ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            script[a : b + 1] = k + 1
    return letter, mark, lower, script


class Words(NamedTuple):
    """Of some texts: the letters' and marks' slots and scripts, and by word its script, first letter, size, place in characters and text."""

    slot: np.ndarray
    script: np.ndarray
    of_word: np.ndarray
    first: np.ndarray
    size: np.ndarray
    place: np.ndarray
    text: np.ndarray


def words(texts: list[str | None]) -> Words:
    letter, mark, lower, script = _characters()
    joined = "\n".join(t or "" for t in texts) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    inside = letter[c] | mark[c]
    at = np.flatnonzero(inside)
    low = np.where(inside, lower[c], 0)
    before, after = np.where(at > 0, low[at - 1], 0), low[at + 1]  # the last is a line end
    h = before * np.uint32(0x9E3779B1) + low[at] * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) > 1
    first = np.flatnonzero(new)
    size = np.diff(first, append=len(at))
    letters = np.append(np.flatnonzero(letter[c[at]]), len(at))
    leading = letters[np.searchsorted(letters, first)]
    real = leading < first + size  # runs of marks alone aren't words
    held = np.repeat(real, size)
    of_word = script[c[at[leading[real]]]]
    size, place, at = size[real], at[first[real]], at[held]
    own = script[c[at]]
    own = np.where(mark[c[at]] & (own == 0), np.repeat(of_word, size), own)  # marks of all scripts go with their word
    text = np.searchsorted(ends, place, "right")
    starts = ends - [len(t or "") + 1 for t in texts]
    return Words((h[held] >> np.uint32(16)).astype(np.uint16), own, of_word, np.cumsum(size) - size, size, place - starts[text] if len(text) else place, text)


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = n = 0
    for i, t in enumerate(texts):
        n += len(t or "") + 1
        if n > PART:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = SLOTS + len(SCRIPTS) + 1
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, z in _parts(texts):
            w = words(texts[a:z])
            own, of = np.unique(np.array(labels[a:z], object), return_inverse=True)
            label = np.repeat(of[w.text], w.size)
            for k, name in enumerate(own):
                mine = label == k
                n = counts.setdefault(name, np.zeros(width, np.int64))
                n[:SLOTS] += np.bincount(w.slot[mine], minlength=SLOTS)
                n[SLOTS:] += np.bincount(w.script[mine], minlength=width - SLOTS)
    for name, n in counts.items():
        slot = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(n[slot], pa.int64())], names=["label", "slot", "n"])


def train(df: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """Learns from all rows with a label. The driver gets SLOTS counts for each of MOST_LABELS languages at most."""
    label, text = F.col(f"`{label_col}`").cast("string"), F.col(f"`{text_col}`")
    rows = df.where(label.isNotNull() & text.isNotNull()).select(label.alias("label"), text.alias("text"))
    if rows.select("label").distinct().limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: {label_col} isn't a column of languages")
    found = rows.mapInArrow(_count, "label string, slot int, n long").groupBy("label", "slot").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found["label"].to_pylist()))
    counts = np.zeros((len(languages), SLOTS + len(SCRIPTS) + 1))
    row = {name: i for i, name in enumerate(languages)}
    counts[[row[x] for x in found["label"].to_pylist()], found["slot"].to_numpy()] = found["n"].to_numpy()
    n, scripts = counts[:, :SLOTS] + 0.02, counts[:, SLOTS:]
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32), share >= USES)


def word_scores(w: Words, model: Model) -> np.ndarray:
    """(word, language), the highest of a word being 0; languages that don't use the word's script are far below."""
    s = np.empty((len(w.first), len(model.languages)), np.float32)
    for k in range(len(model.languages)):
        s[:, k] = np.add.reduceat(model.scores[k][w.slot], w.first)
    uses = model.uses[:, w.of_word].T
    s = np.where(uses | ~uses.any(axis=1, keepdims=True), s, np.float32(-1e6))
    return s - s.max(axis=1, keepdims=True)


def _step(v: np.ndarray, score: np.ndarray, penalty: float) -> np.ndarray:
    return np.maximum(v, v.max(axis=-1, keepdims=True) - penalty) + score


def viterbi(scores: np.ndarray, text: np.ndarray, penalty: float, stretch: int = STRETCH) -> np.ndarray:
    """The language of each word on its text's best path. text: the text of each word, in order."""
    n, m = scores.shape
    if not n:
        return np.empty(0, np.int64)
    begins = np.flatnonzero(np.diff(text, prepend=text[0] - 1))
    sizes = np.diff(begins, append=n)
    per = -(-sizes // stretch)  # stretches of each text
    of = np.repeat(np.arange(len(begins)), per)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    start = begins[of] + nth * stretch
    size = np.minimum(stretch, sizes[of] - nth * stretch)
    low = np.float32(-1e9)
    first, last = np.full(len(of), -1), np.full(len(of), -1)  # languages at the ends of stretches, where a text has several
    long = np.flatnonzero(per[of] > 1)
    if len(long):
        # best paths within each stretch from each language to each
        long = long[np.argsort(-size[long], kind="stable")]
        v = np.where(np.eye(m, dtype=bool), scores[start[long]][:, None, :], low)
        for t in range(1, stretch):
            k = np.searchsorted(-size[long], -t, "left")  # stretches of more than t words
            if not k:
                break
            v[:k] = _step(v[:k], scores[start[long[:k]] + t][:, None, :], penalty)
        within = np.empty((len(of), m, m), np.float32)
        within[long] = v
        # and chained, over all texts at once
        texts = np.flatnonzero(per > 1)
        texts = texts[np.argsort(-per[texts], kind="stable")]
        at = (np.cumsum(per) - per)[texts]
        best = np.zeros((len(texts), m), np.float32)
        came = np.zeros((len(of), m), np.int8 if m < 128 else np.int32)  # the first language of the best path to each last one
        prev = np.zeros((len(of), m), came.dtype)  # and the language before each first one
        for j in range(int(per[texts[0]])):
            k = np.searchsorted(-per[texts], -j, "left")
            s, b = at[:k] + j, best[:k]
            enter = np.maximum(b, b.max(axis=1, keepdims=True) - penalty)
            prev[s] = np.where(b >= enter, np.arange(m), b.argmax(axis=1)[:, None])
            total = enter[:, :, None] + within[s]
            came[s] = total.argmax(axis=1)
            best[:k] = total.max(axis=1)
            best[:k] -= best[:k].max(axis=1, keepdims=True)
        end = best.argmax(axis=1)
        for j in range(int(per[texts[0]]) - 1, -1, -1):
            k = np.searchsorted(-per[texts], -j, "left")
            s = at[:k] + j
            last[s] = end[:k]
            first[s] = came[s, end[:k]]
            end[:k] = prev[s, first[s]]
    # every stretch once more, with its ends fixed where they are known
    order = np.argsort(-size, kind="stable")
    v = scores[start[order]].copy()
    fixed = first[order] >= 0
    v[fixed] = np.where(np.arange(m) == first[order][fixed][:, None], v[fixed], low)
    back = np.full(n, 0, np.int64)  # where a switch comes from
    stays = np.ones((n, m), bool)
    for t in range(1, stretch):
        k = np.searchsorted(-size[order], -t, "left")
        if not k:
            break
        at = start[order[:k]] + t
        top = v[:k].max(axis=1, keepdims=True) - penalty
        stays[at] = v[:k] >= top
        back[at] = v[:k].argmax(axis=1)
        v[:k] = np.maximum(v[:k], top) + scores[at]
    label = np.where(last[order] >= 0, last[order], v.argmax(axis=1))
    out = np.empty(n, np.int64)
    for t in range(stretch - 1, -1, -1):
        k = np.searchsorted(-size[order], -t, "left")
        if not k:
            continue
        at = start[order[:k]] + t
        out[at] = label[:k]
        if t:
            label[:k] = np.where(stays[at, label[:k]], label[:k], back[at])
    return out


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())])
PREDICTED = "lang_pred string, score double, spans array<struct<start:bigint,stop:bigint,lang:string>>"


def label(texts: list[str | None], model: Model, penalty: float) -> tuple[list[str], np.ndarray, pa.Array]:
    """Of each text: its language, the share of its letters that are in spans of it, and its spans (in characters)."""
    m = len(model.languages)
    w = words(texts)
    if not len(w.first) or not m:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), pa.array([[]] * len(texts), pa.list_(_SPAN))
    best = viterbi(word_scores(w, model), w.text, penalty)
    letters = np.bincount(w.text * m + best, w.size, minlength=len(texts) * m).reshape(-1, m)
    top = letters.argmax(axis=1)
    total = letters.sum(axis=1)
    known = np.bincount(w.text * m + best, w.size * model.uses[:, w.of_word].any(axis=0), minlength=len(texts) * m).reshape(-1, m)
    score = np.where(total > 0, known[np.arange(len(texts)), top] / np.maximum(total, 1), 0.0)
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (w.text[1:] != w.text[:-1])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(best)) - 1
    names = pa.array(model.languages, pa.string())
    spans = pa.StructArray.from_arrays([pa.array(w.place[a]), pa.array(w.place[z] + w.size[z]), names.take(pa.array(best[a]))], fields=list(_SPAN))
    offsets = np.searchsorted(w.text[a], np.arange(len(texts) + 1))
    return [model.languages[k] if t else UNKNOWN for k, t in zip(top, total, strict=True)], score, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)


def predict(df: DataFrame, model: Model, text_col: str = "text", penalty: float = 9.0):
    """df with the columns lang_pred, score and spans. penalty: of a switch of language, in nats."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # SLOTS scores a language

    @F.arrow_udf(f"struct<{PREDICTED.replace(' ', ': ', 1).replace(', score ', ', score: ').replace(', spans ', ', spans: ')}>")
    def run(texts: pa.Array) -> pa.Array:
        values, names, scores, spans = texts.to_pylist(), [], [], []
        for a, z in _parts(values):
            n, s, x = label(values[a:z], sent.value, penalty)
            names += n
            scores.append(s)
            spans.append(x)
        spans = pa.concat_arrays(spans) if spans else pa.array([], pa.list_(_SPAN))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), spans], names=["lang_pred", "score", "spans"])

    kept = [c for c in df.columns if c not in ("lang_pred", "score", "spans")]
    found = "_found"
    while found in kept:
        found += "_"
    kept = [F.col(f"`{c}`") for c in kept]
    return df.select(*kept, run(F.col(f"`{text_col}`")).alias(found)).select(*kept, f"{found}.lang_pred", f"{found}.score", f"{found}.spans")
