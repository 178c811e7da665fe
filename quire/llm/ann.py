"""Nearest neighbours by low-dimensional stable projections and a kd-tree, with a chi-square stopping test.

Largest inner product is turned into smallest Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2) with M the longest
vector's length. Vectors are projected on M_DIMS random Gaussian (2-stable) directions: the ratio of squared projected to squared true
distance follows a chi-square law with M_DIMS degrees of freedom. A kd-tree over the projections, fitted on a bounded
sample, gives cells; every vector is put into its cell.

First each query verifies the vectors of its own cell, which bounds the distance of its K-th neighbour. Then cells are visited in order of
projected distance while the test holds: a vector at the K-th distance d would be projected within
d * sqrt(chi2(CONFIDENCE)) with probability CONFIDENCE, so beyond that projected distance nothing is verified; d shrinks as better vectors are
found. Scores are inner products of the original vectors in double precision.

Equal vectors are indexed once, with their K + 1 smallest ids: no more can be among K nearest, as ties go to smaller ids.

Queries are routed down the tree to the cells that the test lets them visit, and only those travel. Where data has no low-dimensional structure, as
vectors spread evenly over a sphere, the test lets a query visit nearly every cell: a share of all pairs is verified then, whatever the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import hashed_share, materialise, table

K = 20
M_DIMS = 8
CONFIDENCE = 0.97
SAMPLE = 20_000
#: Vectors of a cell; of a leaf of the tree inside; queries of a block; cells; queries searched together; vectors projected together.
CELL = 32_768
LEAF = 512
BLOCK = 32_768
MAX_CELLS = 1 << 14
QUERIES = 1_000
SLICE = 2_000
QUERY_EVERY = 20
ROUTED = "cell long, query_id long, embedding array<double>, kth double"


def chi2_quantile(p: float, k: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom, by bisection."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= mid / 2 / i
            total += term
        lo, hi = (mid, hi) if 1 - np.exp(-mid / 2) * total < p else (lo, mid)
    return hi


@dataclass
class Tree:
    """Splits of a kd-tree over projections; cells are its leaves. Cell boxes are open at the outside."""

    dims: list[int]
    cuts: list[float]
    lows: np.ndarray
    highs: np.ndarray
    left: list[int]
    right: list[int]

    @staticmethod
    def fit(points: np.ndarray, cells: int) -> Tree:
        t = Tree([], [], np.zeros((0, 0)), np.zeros((0, 0)), [], [])
        lows, highs = [], []

        def grow(x: np.ndarray, n: int, lo: np.ndarray, hi: np.ndarray) -> int:
            spread = x.max(0) - x.min(0) if len(x) else np.zeros(len(lo))
            d = int(spread.argmax())
            if n <= 1 or len(x) < 2 or spread[d] <= 0:
                lows.append(lo)
                highs.append(hi)
                return -len(lows)
            cut = float(np.median(x[:, d]))
            below = x[:, d] < cut
            if not below.any():
                cut = float(x[x[:, d] > cut, d].min())
                below = x[:, d] < cut
            at = len(t.dims)
            t.dims.append(d)
            t.cuts.append(cut)
            t.left.append(0)
            t.right.append(0)
            hi_l, lo_r = hi.copy(), lo.copy()
            hi_l[d] = lo_r[d] = cut
            t.left[at] = grow(x[below], n // 2, lo, hi_l)
            t.right[at] = grow(x[~below], n - n // 2, lo_r, hi)
            return at

        m = points.shape[1]
        grow(points, cells, np.full(m, -np.inf), np.full(m, np.inf))
        t.lows, t.highs = np.array(lows), np.array(highs)
        return t

    def cell(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        if not self.dims:
            return out
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            below = x[rows, self.dims[at]] < self.cuts[at]
            for side, some in ((self.left[at], rows[below]), (self.right[at], rows[~below])):
                if side < 0:
                    out[some] = -side - 1
                elif len(some):
                    stack.append((side, some))
        return out

    def within(self, x: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(cell, rows, distances) of the points whose projected distance to the cell's box is within their reach, by descent: a side
        that is too far for all points isn't entered."""
        if not self.dims:
            yield 0, np.arange(len(x)), np.zeros(len(x))
            return
        stack = [(0, np.arange(len(x)), np.zeros_like(x))]
        while stack:
            at, rows, gap = stack.pop()
            d, off = self.dims[at], x[rows, self.dims[at]] - self.cuts[at]
            for side, beyond in ((self.left[at], np.maximum(off, 0)), (self.right[at], np.maximum(-off, 0))):
                far = gap.copy()
                far[:, d] = np.maximum(far[:, d], beyond)
                dist = np.sqrt((far**2).sum(1))
                ok = dist <= reach[rows]
                if ok.any():
                    if side < 0:
                        yield -side - 1, rows[ok], dist[ok]
                    else:
                        stack.append((side, rows[ok], far[ok]))


@dataclass
class Index:
    directions: np.ndarray  # (dims + 1) x M_DIMS
    longest: float
    tree: Tree
    factor: float

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return np.column_stack([x, last])

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        return self.lift(x, query) @ self.directions

    def reach(self, norm2: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Projected distance beyond which nothing is verified, for queries with squared norm and K-th best inner product."""
        return self.factor * np.sqrt(np.maximum(norm2 + self.longest**2 - 2 * kth, 0))


def _array(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _search(index: Index, q: np.ndarray, kth: np.ndarray, x: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verify x for the queries in order of projected distance, leaf by leaf of a local kd-tree, while the test holds.

    kth: an inner product that k + 1 vectors are known to reach, -inf if none. Gives (query, row, score): the k + 1 best rows of each query that reach it, ties to
    the smaller first id."""
    pq, px = index.project(q, True), index.project(x, False)
    local = Tree.fit(px, max(1, len(px) // LEAF))
    cell = local.cell(px)
    leaves = np.split(np.argsort(cell, kind="stable"), np.cumsum(np.bincount(cell, minlength=len(local.lows)))[:-1])
    boxes = np.full((len(q), len(leaves)), np.inf)
    for c, rows, dist in local.within(pq, np.full(len(q), np.inf)):
        boxes[rows, c] = dist
    norm2, kth = (q**2).sum(1), kth.copy()
    order, nq, nx = boxes.argsort(1), (pq**2).sum(1), (px**2).sum(1)
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for step in range(len(leaves)):
        at = order[:, step]
        reach = index.reach(norm2, kth)
        live = np.flatnonzero(boxes[np.arange(len(q)), at] <= reach)
        if not len(live):
            continue
        new = [held]
        for c in np.unique(at[live]):
            rows, some = leaves[c], live[at[live] == c]
            if not len(rows):
                continue
            score = q[some] @ x[rows].T
            least = kth[some]
            if len(rows) > k + 1:
                least = np.maximum(least, np.partition(score, len(rows) - k - 1, axis=1)[:, len(rows) - k - 1])
            near2 = nq[some][:, None] + nx[rows][None] - 2 * pq[some] @ px[rows].T
            i, j = np.nonzero((score >= least[:, None]) & (near2 <= (reach[some] ** 2 + 1e-9)[:, None]))
            new.append((some[i], rows[j], score[i, j]))
        who, row, score = (np.concatenate(z) for z in zip(*new, strict=True))
        by = np.lexsort((first[row], -score, who))
        who, row, score = who[by], row[by], score[by]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        full = rank == k
        kth[who[full]] = np.maximum(kth[who[full]], score[full])
        held = (who[rank <= k], row[rank <= k], score[rank <= k])
    return held


FOUND = "query_id long, ids array<long>, score double"


def _visit(index: Index, k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "ids": [], "score": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        x, first = np.stack(right["embedding"].to_numpy()), right["first"].to_numpy()
        ids, out = right["ids"].to_numpy(), [empty]
        for at in range(0, len(left), QUERIES):
            some = left.iloc[at : at + QUERIES]
            who, row, score = _search(index, np.stack(some["embedding"].to_numpy()), some["kth"].to_numpy(float), x, first, k)
            out.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[who], "ids": ids[row], "score": score}))
        return pd.concat(out) if len(out) > 1 else empty

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k best vectors of each query but itself; a vector that comes more than once counts by its best score."""
    rows = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    once = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")).where(F.col("rank") <= k)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector can take part: not null, not zero, all components finite; of the commonest dimension if they differ."""
    ok = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(ok & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == sizes[0]["d"]) if sizes else rows


def nearest(vectors: DataFrame, is_query, k: int = K, cell: int = CELL, confidence: float = CONFIDENCE, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors(vec_id, embedding) for which the column is_query holds.

    Vectors that are null, zero, of another dimension than most, or hold null or non-finite components take no part;
    repeated rows (same id and vector) count once; with fewer than k candidates all are given. An empty table gives no rows."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    stat = rows.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)).alias("m"), F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not stat["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # equal vectors: their k + 1 smallest ids
    keyed = rows.distinct().withColumn("h", F.xxhash64("embedding"))
    some = keyed.withColumn("r", F.expr("row_number() OVER (PARTITION BY h, embedding ORDER BY vec_id)")).where(F.col("r") <= k + 1)
    classes = some.groupBy("h", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("first"))
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((stat["d"] + 1, M_DIMS))
    index = Index(directions, float(np.sqrt(stat["m"])), Tree.fit(np.zeros((1, M_DIMS)), 1), float(np.sqrt(chi2_quantile(confidence, M_DIMS))))
    cells = min(MAX_CELLS, max(1, stat["n"] // cell))
    sample = rows.where(hashed_share(F.col("vec_id"), max(SAMPLE, 16 * cells), stat["n"])).select("embedding")

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                p = index.project(_array(batch.column("embedding").slice(at, SLICE)), False)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in p], pa.binary())], ["p"])

    got = sample.mapInArrow(projected, "p binary").toArrow().column("p")  # M_DIMS numbers for each row of the sample
    points = np.array([np.frombuffer(b.as_py()) for b in got]).reshape(-1, M_DIMS)
    index.tree = Tree.fit(points[np.lexsort(points.T)], cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                own = index.tree.cell(index.project(_array(some.column("embedding")), False))
                yield pa.RecordBatch.from_arrays([pa.array(own), some.column("first"), some.column("ids"), some.column("embedding")], ["cell", "first", "ids", "embedding"])

    indexed = materialise(classes.select("first", "ids", "embedding").mapInArrow(place, "cell long, first long, ids array<long>, embedding array<double>"), "cells")
    queries = rows.where(is_query).distinct().select(F.col("vec_id").alias("query_id"), "embedding")

    def visits(home: bool):
        """The cells that a query visits: the one it would lie in, or the others that the stopping test lets it visit."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, QUERIES):
                    some = batch.slice(at, QUERIES)
                    q, kth = _array(some.column("embedding")), some.column("kth").to_numpy(zero_copy_only=False)
                    p = index.project(q, True)
                    own = index.tree.cell(p)
                    reach = index.reach((q**2).sum(1), kth)
                    for c, to in [(c, np.flatnonzero(own == c)) for c in np.unique(own)] if home else ((c, i[own[i] != c]) for c, i, _ in index.tree.within(p, reach)):
                        take = pa.array(to)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), c)), *(some.column(name).take(take) for name in ("query_id", "embedding", "kth"))], ["cell", "query_id", "embedding", "kth"])

        return run

    # a cell is dealt in slots of `cell` vectors, its queries in blocks of BLOCK; only cells that are larger or asked more often have several
    sizes = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}  # MAX_CELLS rows
    slots = spark.createDataFrame([(c, -(-n // (2 * cell))) for c, n in sizes.items()], "cell long, slots int")

    def visited(to: DataFrame, name: str) -> DataFrame:
        to = materialise(to, name)
        asked = to.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # MAX_CELLS rows
        dealt = F.broadcast(slots.join(asked, "cell"))
        left = to.join(dealt, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        right = indexed.join(dealt, "cell").withColumn("slot", F.pmod(F.xxhash64("first"), F.col("slots")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        left, right = left.select("cell", "slot", "block", "query_id", "embedding", "kth"), right.select("cell", "slot", "block", "first", "ids", "embedding")
        return left.groupBy("cell", "slot", "block").cogroup(right.groupBy("cell", "slot", "block")).applyInPandas(_visit(index, k), FOUND)

    infinite = F.lit(float("-inf"))
    first = materialise(visited(queries.withColumn("kth", infinite).mapInArrow(visits(True), ROUTED), "home"), "first")
    # a query's k + 1 best vectors of its own cell, itself perhaps among them, bound the k-th best of all
    bound = first.groupBy("query_id").agg(F.array_sort(F.collect_list("score"), lambda x, y: F.when(x > y, -1).when(x < y, 1).otherwise(0)).alias("s")).where(F.size("s") > k)
    again = queries.join(bound.select("query_id", F.col("s")[k].alias("kth")), "query_id", "left").select("query_id", "embedding", F.coalesce("kth", infinite).alias("kth"))
    more = visited(again.mapInArrow(visits(False), ROUTED), "away")
    return _best(first.unionByName(more), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
