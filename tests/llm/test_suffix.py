"""Operator 1 against all strings of all documents."""

import hashlib
import random

import numpy as np

from inkframe.llm import queries, suffix


def plain(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - length + 1):
                s = b[p : p + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    gone[p : p + length] = b"\1" * length
        runs = [len(r) for r in bytes(gone).split(b"\0") if r]
        out.append((i, len(b), sum(runs), len(runs), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=lambda r: (r[0] is None, r))


def compare(df, rows, length=50):
    got = df.collect()
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=lambda r: (r[0] is None, r)) == plain(rows, length)


def mixed(rng, n):
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(40, 160))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice([rng.choice(passages), "".join(rng.choice("xyz é") for _ in range(rng.randrange(60))), rng.choice(passages)[5:90]]) for _ in range(rng.randrange(6)))
        rows.append((rng.randrange(2 * n), text))
    return rows


def test_random_texts(spark, docs):
    rng = random.Random(4)
    rows = mixed(rng, 120)
    rows += [(1, None), (2, ""), (None, rows[0][1]), (None, "é" * 40), (3, "a" * 300), (9, "a" * 70), (4, "ab" * 100), (8, "b" + "ab" * 60), (8, "b" + "ab" * 60), (5, "q" * 49), (6, "q" * 49), (500, "r" * 50), (501, "r" * 50)]
    compare(suffix.dedup(docs(rows).repartition(5)), rows)


def test_hot_seeds_are_sent_string_by_string(spark, docs, monkeypatch):
    """A frequent phrase with other text around it in each document, seeds in many chunks, and a text over several parts."""
    monkeypatch.setattr("inkframe.llm.chunks.CHUNK", 300)
    monkeypatch.setattr(suffix, "HOT", 2)
    monkeypatch.setattr(suffix, "_PART", 32_768)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    phrase, tails = word(40), [word(30) for _ in range(5)]
    rows = [(i, word(rng.randrange(60)) + phrase + rng.choice(tails)[: rng.randrange(30)] + word(40)) for i in range(60)]
    long = word(70_000)
    rows += [(100, long), (99, long[20_000:50_000] + word(30)), (101, "x" + long[32_700:32_900])]
    compare(suffix.dedup(docs(rows).repartition(6)), rows)
    monkeypatch.setattr(suffix, "HOT", 0)
    for length in (16, 50, 90):
        compare(suffix.dedup(docs(rows).repartition(3), length=length), rows, length)


def test_kept_columns_may_have_any_name(spark):
    rows = [(1, "a" * 60, "p", 1.5), (2, "a" * 60, "q", None)]
    got = suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string, id string, `a.b` double"), keep=["id", "a.b"])
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "id", "a.b"]
    assert sorted((r.doc_id, r.n_removed, r.id, r["a.b"]) for r in got.collect()) == [(1, 0, "p", 1.5), (2, 60, "q", None)]


def test_other_lengths_and_none(spark, docs):
    rows = mixed(random.Random(5), 30)
    for length in (16, 90):
        compare(suffix.dedup(docs(rows).repartition(2), length=length), rows, length)
    assert suffix.dedup(docs([])).collect() == []


def test_suffixes_are_sorted():
    rng = np.random.default_rng(6)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    start, cell = rng.permutation(2900), rng.integers(0, 5, 2900)
    s = suffix.Suffixes(text, 50)
    order = s.sort(cell, start)
    want = sorted(range(2900), key=lambda i: (cell[i], text[start[i] : start[i] + 50].tobytes()))
    key = lambda i: (cell[i], text[start[i] : start[i] + 50].tobytes())
    assert [key(i) for i in order] == [key(i) for i in want]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in queries.op1_suffix_dedup(spark, sf).collect()}
    assert got == {(i, n, m, k, hashlib.sha256(b).hexdigest()) for i, n, m, k, b in plain(rows)}
    assert any(r[2] for r in got)
