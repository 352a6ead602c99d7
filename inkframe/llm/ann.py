"""Operator 8: approximate nearest neighbours by stable projections and kd-trees.

Vectors are scaled to length 1 and projected to ``DIMENSIONS`` coordinates by a Gaussian matrix, so that a squared
distance in the projection, divided by the true one, follows a chi-square distribution. Projected points are taken in
order of their distance from the projected query and verified with their original vectors. A row of norm r has a product
of s or more with the query q only if the two directions are no further apart than 2 - 2 s / (r |q|). With s the k-th best
product so far, the search stops when the next projected point is so far away that a row with a better product would
have come before it with a chance of ``confidence``.

On Spark: a kd-tree over a bounded sample of projections (``SAMPLE`` at most), cut at gaps near the median, deals the rows
to cells. An aggregation gives each cell the box of its projections and its norms; cells with many rows are split by
hash. A query first looks at the few nearest points of the ``PROBES`` nearest cells; the product that k of them reach decides by
the stopping test which cells it goes to and where the search in each stops. In a part of a cell, the rows' own kd-tree has leaves of a few dozen points; leaves are opened in
order of their boxes' distance, and a point is verified once no closed leaf can hold a nearer one.

The nearer a query's neighbours are than other rows, the sooner it stops. Where all rows are about equally far away, as
with directions that are spread evenly, no bound on distances leaves much out, and most cells are visited.

Vectors that are null, empty or zero, or hold null or non-finite components, take no part. All vectors have one
length; shorter ones count as filled with zeros. Rows with the query's id are the query's own. Queries with
equal ids are one query, with the smallest of their vectors; other repeated rows are candidates of their own.
Null ids are candidates only if nothing else is nearer (they go last in ties). Further columns are dropped; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, save

DIMENSIONS, SAMPLE, LEAF = 32, 100_000, 48
#: Rows of a part of the index, and the least number of parts.
ROWS, LEAST_PARTS = 8_192, 8
#: Cells that a query first looks at, and points there for each neighbour wanted.
PROBES, FEW = 4, 4
#: Queries that a task looks at together, and points that are verified together at first.
TOGETHER, STEP = 128, 64
_NO_ID = np.iinfo(np.int64).max


def quantile(confidence: float, m: int = DIMENSIONS) -> float:
    """Of the chi-square distribution with an even number of degrees of freedom."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 1.0
    while below(high) < confidence:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < confidence else (low, mid)
    return high


def projection(width: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, DIMENSIONS))


def norms(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(axis=1, initial=0)  # so that no square overflows
    scale = np.where(largest > 0, largest, 1)
    return np.sqrt(((x / scale[:, None]) ** 2).sum(axis=1)) * scale


def project(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Of the directions of x."""
    return (x / np.maximum(norms(x), np.finfo(float).tiny)[:, None]) @ g


def apart(product: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest squared distance of directions at which a row with a norm from low to high may reach the product."""
    with np.errstate(all="ignore"):
        least = product / (norm * np.where(product > 0, high, low))
    return np.where(np.isneginf(product), np.inf, 2 - 2 * least)


def split(points: np.ndarray, rows: np.ndarray, leaf: int) -> Iterator[np.ndarray]:
    """The leaves of a kd-tree over these rows: cut at the median of the widest coordinate."""
    todo = [rows]
    while todo:
        r = todo.pop()
        if len(r) <= leaf:
            yield r
            continue
        axis, value = cut(points[r])
        left = points[r, axis] <= value
        if not 0 < left.sum() < len(r):  # equal points
            left = np.arange(len(r)) < len(r) // 2
        todo += [r[~left], r[left]]


def cut(y: np.ndarray) -> tuple[int, float]:
    """The axis that varies most, and the middle of its widest gap between its fourth and sixth tenths."""
    axis = int(np.argmax(y.var(axis=0)))
    v = np.sort(y[:, axis])
    a, z = int(0.4 * (len(v) - 1)), int(np.ceil(0.6 * (len(v) - 1)))
    at = a + int(np.argmax(np.diff(v[a : z + 1]))) if z > a else a
    return axis, float(v[at] / 2 + v[min(at + 1, len(v) - 1)] / 2)


class Cells:
    """A kd-tree over a sample: each node has an axis, a value and two children; cells are its leaves."""

    def __init__(self, sample: np.ndarray, wanted: int):
        self.axis, self.value, self.child, self.n = [], [], [], 0
        self._grow(sample, max(0, (wanted - 1).bit_length()))

    def _grow(self, y: np.ndarray, depth: int) -> int:
        if depth and len(y) > 1:
            axis, value = cut(y)
            left = y[:, axis] <= value
            if 0 < left.sum() < len(y):
                node = len(self.axis)
                self.axis.append(axis), self.value.append(value), self.child.append([0, 0])
                self.child[node] = [self._grow(y[left], depth - 1), self._grow(y[~left], depth - 1)]
                return node
        self.n += 1
        return -self.n  # -1 is cell 0

    def of(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y), np.int64)
        todo = [(0 if self.axis else -1, np.arange(len(y)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                left = y[rows, self.axis[node]] <= self.value[node]
                todo += [(self.child[node][0], rows[left]), (self.child[node][1], rows[~left])]
        return out


def box_distance(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(query, box): squared distances."""
    out = np.zeros((len(y), len(low)))
    for j in range(y.shape[1]):
        d = np.maximum(0, np.maximum(low[:, j] - y[:, j, None], y[:, j, None] - high[:, j]))
        out += d * d
    return out


class Part:
    """Rows of a part of a cell: vectors, ids, projections, norms, and the leaves of their kd-tree with their boxes."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, row: np.ndarray, g: np.ndarray):
        y = project(x, g)
        self.leaves = list(split(y, np.arange(len(x)), LEAF))
        order = np.concatenate(self.leaves)  # leaves lie one after the other
        self.x, self.ids, self.row, self.y, self.norm = x[order], ids[order], row[order], y[order], norms(x[order])
        size = np.array([len(r) for r in self.leaves])
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.low, self.high = np.minimum.reduceat(self.y, self.starts), np.maximum.reduceat(self.y, self.starts)
        self.square = (self.y * self.y).sum(axis=1)
        self.least, self.most = float(self.norm.min()), float(self.norm.max())

    def search(self, q: np.ndarray, q_id: int, y: np.ndarray, near: np.ndarray, bound: float, k: int, c: float, most: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows of the k nearest found here, their products, and how many rows were verified. near: the leaves' distances;
        bound: a product that k rows elsewhere reach; most: rows after which a first look ends."""
        norm = float(norms(q[None, :])[0])
        order = np.argsort(near, kind="stable")
        waiting, distance = np.empty(0, np.int64), np.empty(0)
        rows, products, best = [], [], bound
        at, step, verified, limit = 0, 4, 0, np.inf
        while True:
            limit = c * float(apart(np.float64(best), norm, self.least, self.most)) + 1e-12
            opened = order[at : at + step]
            opened = opened[near[opened] <= limit]
            at, step = at + step, step * 2
            if len(opened):
                new = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in opened])
                d = np.maximum(0, self.square[new] - 2 * (self.y[new] @ y) + y @ y)
                waiting, distance = np.concatenate((waiting, new)), np.concatenate((distance, d))
            closed = near[order[at]] if at < len(order) and len(opened) else np.inf
            ready = distance <= closed
            now, d = waiting[ready], distance[ready]
            waiting, distance = waiting[~ready], distance[~ready]
            sort = np.argsort(d, kind="stable")
            now, d, a, size = now[sort], d[sort], 0, STEP
            while a < len(now):
                z = min(len(now), a + size)
                limit = c * float(apart(np.float64(best), norm, self.least, self.most)) + 1e-12
                if d[a] > limit or verified >= most:
                    return self._top(rows, products, q, k, verified)
                r = now[a:z]
                # a row's own norm may rule it out before it is verified
                r = r[(d[a:z] <= c * apart(np.full(len(r), best), norm, self.norm[r], self.norm[r]) + 1e-12) & (self.ids[r] != q_id)]
                rows.append(r), products.append(self.x[r] @ q)
                verified += len(r)
                a, size = z, size * 2
                found = np.concatenate(products)
                if len(found) >= k:
                    best = max(best, float(np.partition(found, len(found) - k)[len(found) - k]))
            if not len(opened) or at >= len(order) and not len(waiting):
                return self._top(rows, products, q, k, verified)

    def _top(self, rows: list, products: list, q: np.ndarray, k: int, verified: int) -> tuple[np.ndarray, np.ndarray, int]:
        if not rows:
            return np.empty(0, np.int64), np.empty(0), verified
        rows, products = np.concatenate(rows), np.concatenate(products)
        if len(rows) > k:
            least = np.partition(products, len(products) - k)[len(products) - k]
            rows = rows[products >= least - 1e-9 * (1 + abs(least))]
        score = (self.x[rows] * q).sum(axis=1)  # one order of additions for all rows, so that equal vectors tie
        top = np.lexsort((self.ids[rows], -score))[:k]
        return rows[top], score[top], verified


_FOUND = "query_id long, vec_id long, score double, verified long, row long"


def _searching(g, k: int, width: int, c: float, most: float):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("verified", pa.int64()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                part = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                for a, z in zip(cuts, cuts[1:]):
                    if z > a:
                        yield int(part[a]), batch.slice(a, z - a)

        for _, group in groupby(pieces(), key=lambda p: p[0]):
            # the part's rows go before its queries, which are taken as they come
            rows, part = [], None
            for _, batch in group:
                is_query = np.asarray(batch.column(3))
                n_rows = int((~is_query).sum())
                if n_rows:
                    rows.append(batch.slice(0, n_rows))
                queries = batch.slice(n_rows)
                if not queries.num_rows or not rows and part is None:
                    continue
                if part is None:
                    table = pa.Table.from_batches(rows)
                    part = Part(filled(table["vector"], width), np.asarray(table["id"].fill_null(_NO_ID)), np.asarray(table["row"]), g.value)
                    rows = []
                for a in range(0, queries.num_rows, TOGETHER):
                    own = queries.slice(a, TOGETHER)
                    q, ids, bound = filled(own.column(2), width), np.asarray(own.column(1)), np.asarray(own.column(4))
                    y = project(q, g.value)
                    near = box_distance(y, part.low, part.high)
                    out = []
                    for i in range(len(q)):
                        r, score, verified = part.search(q[i], int(ids[i]), y[i], near[i], float(bound[i]), k, c, most)
                        count = np.zeros(len(r), np.int64)
                        count[:1] = verified
                        out.append((np.full(len(r), ids[i]), part.ids[r], score, count, part.row[r]))
                    columns = [np.concatenate(v) for v in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=columns[1] == _NO_ID), *map(pa.array, columns[2:])], schema=schema)

    return run


def filled(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(column.offsets), np.asarray(column.flatten())
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _takes_part(vector: Column) -> Column:
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, number) & F.exists(vector, lambda v: v != 0)


def neighbours(df: DataFrame, is_query: Column, k: int = 20, confidence: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, verified): the k nearest found of each row that is_query holds for, among all rows
    with other ids. verified, at rank 1: the number of rows whose product with the query was made, counted again where it was made again."""
    spark = df.sparkSession
    vector = F.col(vector_col) if df.schema[vector_col].dataType.simpleString() == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(_takes_part(F.col("vector")))
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    c = quantile(confidence)
    g = spark.sparkContext.broadcast(projection(width))  # DIMENSIONS numbers for each component

    @F.arrow_udf("array<float>")
    def projected(vectors: pa.Array) -> pa.Array:
        y = project(filled(vectors, width), g.value).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * DIMENSIONS, pa.int32()), pa.array(y.ravel()))

    chance = F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(chance < 0.8 * SAMPLE / n).select(projected("vector").alias("y")).limit(SAMPLE).toArrow()["y"]
    parts = max(LEAST_PARTS, -(-n // ROWS))
    tree = spark.sparkContext.broadcast(Cells(filled(sample, DIMENSIONS), min(parts, max(1, SAMPLE // 8))))  # a node for each cell

    @F.arrow_udf("struct<cell: int, y: array<float>, norm: double>")
    def placed(vectors: pa.Array) -> pa.Array:
        x = filled(vectors, width)
        y = project(x, g.value)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * DIMENSIONS, pa.int32()), pa.array(y.astype(np.float32).ravel()))
        return pa.StructArray.from_arrays([pa.array(tree.value.of(y), pa.int32()), lists, pa.array(norms(x))], names=["cell", "y", "norm"])

    rows = save(rows.select("*", placed("vector").alias("p")).select("id", "vector", "is_query", "p.cell", "p.y", "p.norm", F.monotonically_increasing_id().alias("row")), "vectors-by-cell")
    # boxes: a row for each cell, so bounded like the tree
    coordinates = [f(F.col("y")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(DIMENSIONS)]
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"), *coordinates).orderBy("cell").collect()
    most = max(64, 2 * n // parts)
    splits = spark.createDataFrame([(r.cell, -(-r.n // most)) for r in cells], "cell int, splits int")
    box = lambda name: np.array([[r[f"{name}{i}"] for i in range(DIMENSIONS)] for r in cells]) + (-1 if name == "low" else 1) * 1e-5
    boxes = spark.sparkContext.broadcast((np.array([r.cell for r in cells]), box("low"), box("high"), np.array([r.least for r in cells]), np.array([r.most for r in cells])))
    salted = rows.join(F.broadcast(splits), "cell").withColumn("part", F.xxhash64("cell", F.pmod(F.xxhash64("id", "vector"), F.col("splits").cast("bigint"))))
    data = salted.select("part", "id", "vector", F.lit(False).alias("is_query"), F.lit(0.0).alias("bound"), "row")
    queries = rows.where("is_query and id is not null").groupBy("id").agg(F.min(F.struct("vector", "cell")).alias("q")).select("id", "q.*")

    @F.arrow_udf("array<int>")
    def visits(vectors: pa.Array, bound: pa.Array) -> pa.Array:
        number, low, high, least, most = boxes.value
        q, b, out = filled(vectors, width), np.asarray(bound), []
        for a in range(0, len(q), TOGETHER):
            s = slice(a, a + TOGETHER)
            near = box_distance(project(q[s], g.value), low, high)
            go = near <= c * apart(b[s][:, None], norms(q[s])[:, None], least[None, :], most[None, :]) + 1e-12
            out += [number[np.flatnonzero(x)] for x in go]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in out], dtype=np.int64)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int32()))

    @F.arrow_udf("array<int>")
    def nearest(vectors: pa.Array, cell: pa.Array) -> pa.Array:
        number, low, high, _, _ = boxes.value
        q, own, out = filled(vectors, width), np.asarray(cell), []
        for a in range(0, len(q), TOGETHER):
            near = box_distance(project(q[a : a + TOGETHER], g.value), low, high)
            near[number[None, :] == own[a : a + TOGETHER, None]] = -1
            out.append(number[np.argsort(near, axis=1, kind="stable")[:, :PROBES]])
        out = np.concatenate(out) if out else np.empty((0, 1), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel(), pa.int32()))

    def searched(asked: DataFrame, most: float = float("inf")) -> DataFrame:
        """asked: id, vector, bound, cell."""
        sent = asked.join(F.broadcast(splits), "cell").withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("splits") - 1), lambda i: F.xxhash64("cell", i.cast("bigint")))))
        both = data.unionByName(sent.select("part", "id", "vector", F.lit(True).alias("is_query"), "bound", F.lit(0).cast("long").alias("row")))
        return both.repartition("part").sortWithinPartitions("part", "is_query").mapInArrow(_searching(g, k, width, c, most), _FOUND)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    def best(found: DataFrame) -> DataFrame:
        """The k best of each query, a row once; the number of verified rows stands at the best one."""
        rows = found.groupBy("query_id", "row").agg(F.min("vec_id").alias("vec_id"), F.max("score").alias("score"), F.sum("verified").alias("verified"))
        rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("verified", F.sum("verified").over(Window.partitionBy("query_id")))
        return rows.where(F.col("rank") <= k).withColumn("verified", F.when(F.col("rank") == 1, F.col("verified")).otherwise(0))

    probed = queries.withColumn("bound", F.lit(float("-inf"))).withColumn("cell", F.explode(nearest("vector", "cell")))
    first = save(best(searched(probed, FEW * k)), "vectors-first")
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    asked = queries.drop("cell").join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    asked = save(asked.withColumn("cell", F.explode(visits("vector", "bound"))), "vectors-asked")
    found = save(best(searched(asked).unionByName(first.drop("rank"))), "vectors-found")
    drop(rows), drop(first), drop(asked)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")
