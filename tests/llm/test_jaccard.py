"""Operator 3 against all pairs."""

import random
import re

import numpy as np

from inkframe.llm import jaccard, queries
from inkframe.llm.components import components


def plain(rows, percent=75, n=5):
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()})
    ids = [i for i, _ in rows]
    up = {i: i for i in ids if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by_token = {}
    for k, s in enumerate(sets):
        for t in s:
            by_token.setdefault(t, []).append(k)
    pairs = {(a, b) for ks in by_token.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        if ids[a] is not None and ids[b] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(ids[a]), find(ids[b])
            up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i) if i is not None else None) for i, s in zip(ids, sets, strict=True))


key = lambda r: tuple((x is None, x or 0) for x in r)


def compare(df, rows):
    got = sorted((tuple(r) for r in df.collect()), key=key)
    want = sorted(plain([(i, t) for i, t in rows if i is not None]), key=key) if all(i is not None for i, _ in rows) else None
    if want is not None:
        assert got == want
    return got


def family(rng, ids, size=60):
    """Documents of one text, each with a few words changed."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for i in ids:
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(words[: size - rng.randrange(8)])))
    return out


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 5), (5, 9), (3, 3)] + [(200, i) for i in range(201, 240)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 100 for i in range(100, 161)} | {5: 5, 7: 5, 9: 5} | {i: 200 for i in range(200, 240)}


def test_links(spark, docs):
    rng = random.Random(1)
    rows = [(i, " ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(40)))) for i in range(1000, 1100)]
    at = 0
    for n in (2, 3, 5, 30):
        rows += family(rng, range(at, at + n), rng.choice([12, 30, 80]))
        at += n
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(i, f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(40)))) for i in range(2000, 2060)]
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "One  two"), (3004, "one two"), (3005, "one two three"), (3006, "É a b c d"), (3007, "é a b c d"), (3007, "é a b c d")]
    compare(jaccard.similar(docs(rows).repartition(5)), rows)


def test_links_in_small_tiles(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8_000)
    monkeypatch.setattr(jaccard, "FAMILY", 8)
    monkeypatch.setattr(jaccard, "BUCKET", 1)
    rng = random.Random(2)
    rows = family(rng, range(120), 50) + family(rng, range(200, 290), 30)
    compare(jaccard.similar(docs(rows).repartition(3)), rows)


def test_documents_of_common_pieces(spark, docs):
    """Texts made of the same passages in many ways: keys have documents of several classes, so tiles are used."""
    rng = random.Random(7)
    passages = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(24)]
    rows = [(i, " ".join(rng.sample(passages, rng.choice([5, 6, 7])))) for i in range(150)]
    rows += [(1000 + i, " ".join([*passages[:9], passages[9 + i % 3], *(["z"] * (i % 4))])) for i in range(40)]
    compare(jaccard.similar(docs(rows).repartition(4)), rows)


def test_one_huge_set_among_tiny_ones():
    """Bitmaps are as long as their band needs."""
    import tracemalloc

    rng = np.random.default_rng(6)
    sets = [np.sort(rng.integers(0, 1 << 63, 2, dtype=np.uint64)) for _ in range(20_000)] + [np.unique(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64))]
    sets[7] = sets[5]
    tracemalloc.start()
    assert jaccard.link(list(range(len(sets))), sets, 75) == [(7, 5)]
    assert tracemalloc.get_traced_memory()[1] < 300_000_000
    tracemalloc.stop()


def test_long_texts_and_clashing_columns(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(1_100_000)]
    text = " ".join(words)
    rows = [(3, text, 1, "a"), (2, text + " end", 2, "b"), (1, "w" * 7_000_000, 3, None), (1, "w" * 7_000_000, 3, None)]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string, n int, label string")).collect()
    n = len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, n + 1, 2), (3, n, 2)]


def test_null_ids_and_empty_tables(spark, docs):
    text = "a b c d e f g h"
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(docs([(None, text), (5, text), (4, text), (None, None)])).collect()}
    assert got == {(None, 4, None), (5, 4, 4), (4, 4, 4), (None, 0, None)}
    assert jaccard.similar(docs([])).collect() == []


def test_bitmap_bound_never_loses_a_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 70, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: 70 - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)))) for k in range(0, 30)]
    edges = jaccard.link(list(range(30)), sets, 75)
    up = {i: i for i in range(30)}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    for a in range(30):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                assert find(a) == find(b)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = compare(queries.op3_ngram_jaccard(spark, sf), rows)
    assert any(i != c for i, _, c in got)
