"""Operator 7 against planted overlaps."""

import random
import re

import numpy as np
import pytest

from inkframe.llm import decontaminate, queries


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, text(rng.randint(16, 60))) for i in range(30)] + [(98, text(5))]
    docs, want = [], set()
    for d in range(120):
        words = text(rng.randint(0, 300))
        if d % 3 == 0:
            i, item = rng.choice(items[:30])
            a = rng.randrange(0, len(item) - 15)
            copied = list(item[a : a + rng.randint(15, 40)])
            for k in range(0, len(copied), 9):
                if d % 2:
                    copied[k + rng.randrange(min(9, len(copied) - k))] = word()
            at = rng.randrange(len(words) + 1)
            words[at:at] = copied
            want.add((d, i))
        elif d % 3 == 1:
            words[3:3] = rng.choice(items[:30])[1][2:9]  # too little
        docs.append((d, ", ".join(words)))
    return docs, [(i, " ".join(w).title()) for i, w in items], want


def test_planted_overlaps_are_found(spark, docs, planted):
    rows, items, want = planted
    rows = [*rows, (500, None), (501, ""), (None, items[3][1]), (502, items[98 - 68][1] + " x"), (7, items[4][1]), (7, items[4][1])]
    test = spark.createDataFrame([(*i, 1) for i in [*items, (None, None), (77, ""), (1004, items[4][1].lower())]], "item_id long, text string, doc_id int")
    out = decontaminate.overlaps(docs(rows), test).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert got == want | {(None, 3), (7, 4), (502, 98)}
    assert sum((r.doc_id, r.item_id) == (7, 4) for r in out) == 2
    assert {r.n_items for r in out if r.item_id == 4} == {2} and {r.n_items for r in out if r.item_id != 4} == {1}
    by = {i: t for i, t in rows}
    for r in out:
        if r.doc_id not in (None, 7, 502):
            found = by[r.doc_id].encode()[r.doc_start : r.doc_stop].decode().split(", ")
            assert len(found) == r.n_words and r.n_equal >= 0.75 * r.n_words


def brute(rows, items, least_item=5):
    """Every document and item, at every diagonal and place at which a mask fits word for word."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    number = {}
    hashed = lambda ws: np.array([number.setdefault(w, len(number) + 1) for w in ws], np.uint64)
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    out = []
    for d, text in rows:
        h = hashed(words(text))
        for i, t in items:
            item = hashed(words(t))
            if len(item) < max(1, least_item):
                continue
            pair = decontaminate.Pair(item, 13, 0.8, 0.75)
            for diagonal in range(-len(h), len(item) + 1):
                for at in range(len(h)):
                    place = at + diagonal
                    if len(item) < decontaminate.SHORT:
                        fits = place == 0 and h[at : at + len(item)].tolist() == item.tolist()
                    else:
                        fits = 0 <= place and any(place + m[-1] < len(item) and at + m[-1] < len(h) and all(h[at + j] == item[place + j] for j in m) for m in masks)
                    if fits:
                        pair.hit(h, diagonal, at)
            if pair.best:
                out.append((d, i, *pair.best))
    return sorted(out, key=lambda r: (r[0] is None, r))


def test_against_brute_force(spark, docs):
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "é", "x1", "A", "b", "c", "d"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 12, 20])))) for i in range(14)]
    items = list({t.lower(): (i, t) for i, t in items[::-1]}.values())
    rows = []
    for d in range(60):
        text = [word() for _ in range(rng.randrange(40))]
        copied = rng.choice(items)[1].split(" ")
        for k in range(len(copied)):
            if rng.random() < 0.15:
                copied[k] = word()
        rows.append((d if d % 7 else None, "; ".join(text[:9] + copied + text[9:])))
    test = spark.createDataFrame(items, "item_id long, text string")
    for least in (1, 5):
        out = decontaminate.overlaps(docs(rows).repartition(3), test, least_item=least).collect()
        got = sorted(((r.doc_id, r.item_id, r.n_words, r.n_equal, r.item_start) for r in out), key=lambda r: (r[0] is None, r))
        want = [(d, i, n, e, at) for d, i, n, e, _, at in brute(rows, items, least)]
        assert got == sorted(want, key=lambda r: (r[0] is None, r)) and got


def test_two_of_fourteen_words(spark, docs):
    """The fifth and tenth word of fourteen changed; six words copied as they are; a very long text."""
    item = [f"w{i}" for i in range(14)]
    changed = [w if i not in (4, 9) else "other" for i, w in enumerate(item)]
    rows = [(1, " ".join(changed)), (2, "so a b c d e f it is"), (3, " ".join(f"z{i}" for i in range(1_000_000)) + " " + " ".join(item))]
    test = spark.createDataFrame([(1, " ".join(item)), (2, "a b c d e f")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_words, r.n_equal) for r in decontaminate.overlaps(docs(rows), test).collect()) == [(1, 1, 14, 12), (2, 2, 6, 6), (3, 1, 14, 14)]


def test_rows_are_cleaned_whatever_their_ids(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, item, 1), (None, "fine", 2), (5, "fine too", 3), (5, f"a {item} b", 4), (6, None, 5)]
    test = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    assert sorted(r._row for r in decontaminate.clean(df, test).collect()) == [2, 3, 5]


def test_none(spark, docs):
    test = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert decontaminate.overlaps(docs([]), test).collect() == []
    assert decontaminate.overlaps(docs([(1, "x")]), test.limit(0)).collect() == []


def test_query_finds_whole_items(spark, sf):
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(d, i) for d, t in rows.items() for i, x in items.items() if f" {x} " in f" {t} "}
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, sf).collect()}
    assert want and want <= got and len(got) <= len(want) + 3


def accepted(equal):
    """What verification accepts: both ends agree, 3 in 4 agree, at most 2 in any 6 differ."""
    return equal[0] and equal[-1] and 4 * sum(equal) >= 3 * len(equal) and all(sum(equal[i : i + 6]) >= 4 for i in range(len(equal) - 5))


def test_masks_leave_nothing_out():
    """Substitutions at any places: the best a run of n words without a seed can do, by the words that agree at its end."""
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    runs = {(1,): 1}
    for n in range(2, 120):
        grown = {}
        for run, equal in runs.items():
            for word in (0, 1):
                r = (*run, word)
                seeded = word and any(len(r) > m[-1] and all(r[len(r) - 1 - m[-1] + i] for i in m) for m in masks)
                if sum(r[-6:]) >= min(6, len(r)) - 2 and not seeded:
                    grown[r[-7:]] = max(grown.get(r[-7:], 0), equal + word)
        runs = grown
        assert n < 7 or all(4 * equal < 3 * n for run, equal in runs.items() if run[-1]), n


@pytest.mark.parametrize("length", [8, 9, 16, 20, 40, 60, 200])
def test_substitutions_at_fixed_places_are_found(length):
    rng = random.Random(length)
    words = [f"w{i}" for i in range(length)]
    every = lambda n, first: [int(i % n != first) for i in range(length)]
    patterns = [every(n, first) for n in (4, 5, 6, 9) for first in range(n)]
    patterns += [[int(i not in (a, b)) for i in range(length)] for a in range(1, min(length, 9) - 1) for b in range(a, min(length, 9) - 1)]
    hashed = lambda ws: np.array([hash(w) & (1 << 63) - 1 for w in ws], np.uint64)
    for equal in patterns:
        if not accepted(equal):
            continue
        h = hashed([f"x{rng.random()}" for _ in range(5)] + [w if e else f"y{rng.random()}" for w, e in zip(words, equal)] + ["z"])
        assert search(h, hashed(words)) == (length, sum(equal), 5, 0), equal


def search(h, item):
    """A document's and an item's words, by seeds."""
    by_seed = {}
    for k in range(len(decontaminate.MASKS)):
        for place, s in enumerate(decontaminate.seeds(item, k).tolist()):
            by_seed.setdefault(s, []).append(place)
    hits = sorted({(place - at, at) for k in range(len(decontaminate.MASKS)) for at, s in enumerate(decontaminate.seeds(h, k).tolist()) for place in by_seed.get(s, ())})
    pair = decontaminate.Pair(item, 13, 0.8, 0.75)
    for diagonal, at in hits:
        pair.hit(h, diagonal, at)
    return pair.best


def longest(equal, least):
    """By trying all: the most words of a stretch that verification accepts, 0 if none has least words."""
    return max((j - i for i in range(len(equal)) for j in range(i + least, len(equal) + 1) if accepted(equal[i:j])), default=0)


@pytest.mark.parametrize("share", [0.15, 0.25, 0.35])
def test_no_overlap_is_lost_to_a_look_elsewhere(share):
    rng = random.Random(f"{share}")
    for _ in range(400):
        length = rng.choice((40, 60))
        equal = [int(rng.random() >= share) for _ in range(length)]
        words = np.arange(1, length + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = np.where(equal, words, words + np.uint64(1))
        want, got = longest(equal, 13), search(h, words)
        assert bool(got) >= bool(want)
        if got:
            n, n_equal, at, place = got
            assert n >= want and at == place and n_equal == sum(equal[at : at + n]) >= 0.75 * n and equal[at] and equal[at + n - 1]


def test_longest_stretch():
    rng = random.Random(4)
    for _ in range(300):
        equal = np.array([rng.random() < 0.7 for _ in range(rng.randint(1, 30))] + [True])
        a, z = decontaminate._longest(equal, 0.75)
        enough = [j - i for i in range(len(equal)) for j in range(i + 1, len(equal) + 1) if equal[i] and equal[j - 1] and equal[i:j].sum() >= 0.75 * (j - i)]
        assert equal[a] and equal[z - 1] and z - a == max(enough)
