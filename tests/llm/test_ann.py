"""Operator 8 against brute force."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkframe.llm import ann, queries


def brute(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = (x * np.array(v, float)).sum(axis=1)
            keep = np.flatnonzero(ids != i)
            order = keep[np.lexsort((ids[keep], -s[keep]))][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def compare(got, want, least):
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(by[r.query_id])
    assert by.keys() == want.keys()
    found = 0
    for q, near in want.items():
        assert len(by[q]) == len(near)
        assert by[q] == sorted(by[q], key=lambda p: (-p[1], p[0]))
        found += len({i for i, _ in by[q]} & {i for i, _ in near})
    assert found >= least * sum(map(len, want.values()))


def run(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<float>, cell string, part int")
    return ann.neighbours(df, F.col("vec_id") % 20 == 0, k=k).collect()


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (5, 24))
    v = np.concatenate((rng.normal(0, 1, (600, 24)), centres[rng.integers(0, 5, 900)] + rng.normal(0, 0.05, (900, 24)), np.repeat(centres[:1], 300, axis=0))).astype(np.float32)
    v *= rng.uniform(0.5, 2, (len(v), 1)).astype(np.float32)
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(len(v)), v, strict=True)]
    compare(run(spark, rows), brute(rows, 20), 0.9)


def test_ties_and_few(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.0, 2.0])]
    got = run(spark, rows, k=5)
    compare(got, brute(rows, 5), 1)
    few = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [0.5, 0.5])]
    compare(run(spark, few), brute(few, 20), 1)


def test_what_takes_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [None, 1.0]), (20, []), (40, [0.0, 0.0]), (7, [-1.0, 3.0]), (None, [0.1, 0.1])]
    got = [(r.query_id, r.rank, r.vec_id) for r in run(spark, rows)]
    assert got == [(0, 1, 1), (0, 2, None), (0, 3, 7)]
    assert run(spark, []) == []


def test_lengths_and_wide_vectors(spark):
    """Shorter vectors count as filled with zeros; norms may differ by many orders."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 1, int(rng.choice([40, 300]))) * 10.0 ** rng.integers(-18, 18)).tolist()) for i in range(400)]
    full = [(i, v + [0.0] * (300 - len(v))) for i, v in np.array([(i, np.float32(v).tolist()) for i, v in rows], object)]
    compare(run(spark, rows), brute(full, 20), 0.9)


def test_clustered_vectors_stop_early(spark):
    """200,000 vectors of 1,000 clusters: under a tenth of the rows is verified, and nine in ten neighbours are found."""
    rng = np.random.default_rng(5)
    n, width, k = 200_000, 64, 20
    x = rng.normal(0, 1, (1_000, width))[rng.integers(0, 1_000, n)] + rng.normal(0, 0.35, (n, width))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(x.ravel()))})
    got = ann.neighbours(spark.createDataFrame(table), F.col("vec_id") % 400 == 0, k=k).toPandas()
    found = got.groupby("query_id").vec_id.apply(set)
    assert len(found) == n // 400
    same = 0
    for q, own in found.items():
        score = x @ x[q]
        score[q] = -np.inf
        same += len(own & set(np.argpartition(-score, k)[:k].tolist()))
    recall, share = same / (k * len(found)), got.groupby("query_id").verified.sum().mean() / n
    print(f"recall {recall:.3f}, verified {share:.4f} of the rows")
    assert recall >= 0.9 and share < 0.1


def test_quantile():
    rng = np.random.default_rng(2)
    assert abs((rng.chisquare(ann.DIMENSIONS, 200_000) < ann.quantile(0.9)).mean() - 0.9) < 0.01


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(queries.op8_nearest_neighbours(spark, sf).collect(), brute(rows, 20), 0.9)
