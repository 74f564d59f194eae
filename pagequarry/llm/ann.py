"""Approximate nearest neighbours: balanced posting lists.

Equal vectors are one class that keeps its `k` + 1 smallest ids (they are tied for every query, and ties go to smaller ids, so
no more can be asked for); a vector that a third of all rows share costs one comparison.

Centroids come from a bounded sample of classes in the driver: k-means, then lists of over twice the mean size are split. A
vector belongs to its nearest list, and near a boundary also to further lists whose centroids lie apart from the chosen ones.
Centroids are searched by a neighbour graph held in memory, for vectors and queries alike; the walk goes on from the BEAM
nearest and from what lies within the query's ratio, so it does not grow with the number of centroids.

A query visits the lists within a ratio of its distance to the nearest centroid. How far apart the lists of a vector lie, and
the ratio, are set on the sample so that RECALL of the true neighbours there lie in visited lists at the least number of
vectors visited; lists are added until they hold enough vectors. Lists longer than BLOCK are dealt out as blocks, and more than
QUERY_BLOCK queries in turns, so neither a list nor its queries are gathered in one task. Every reported distance is computed
from the original vectors in double precision.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows with a
null id, nor vectors of another than the most frequent length (of equally frequent ones, the longest); rows with one id are one
candidate, at its nearest vector; fewer candidates than `k`: all of them; without rows there is no result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pagequarry.llm._common import bounded_batches, materialised, table

#: Most classes that the centroids are fitted on, and most lists before oversized ones are split.
SAMPLE, MOST_LISTS = 16384, 1024
#: Classes that a list should have; a list over BLOCK is dealt out.
LIST, BLOCK = 256, 4096
COPIES, BOUNDARY = 4, 1.15
#: Of a vector's distance to a further list, what its centroid must lie from the centroids chosen already: tried in turn.
SPREADS = (1.0, 0.6, 0.3)
#: Queries of a block of a list that are compared by one task.
QUERY_BLOCK = 1 << 16
RECALL, TRIALS = 0.97, 128
DEGREE, BEAM = 16, 64
BATCH = 256


# centroids --------------------------------------------------------------------------------------------------------------


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[lo : lo + 1024], c).argmin(1) for lo in range(0, len(x), 1024)])


def kmeans(x: np.ndarray, k: int, rounds: int, r: np.random.Generator) -> np.ndarray:
    c = x[np.sort(r.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        of = nearest(x, c)
        n = np.bincount(of, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def balanced_centroids(x: np.ndarray, k: int, seed: int = 4) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = kmeans(x, k, 6, r)
    for _ in range(k):
        of = nearest(x, c)
        sizes = np.bincount(of, minlength=len(c))
        large = [j for j in np.nonzero(sizes > max(8, 2 * len(x) / k))[0] if (x[of == j] != x[of == j][0]).any()]
        if not large or len(c) >= 2 * k:
            break
        halves = [kmeans(x[of == j], 2, 4, r) for j in large[: 2 * k - len(c)]]
        for j, h in zip(large, halves, strict=False):
            c[j] = h[0]
        c = np.concatenate([c, *(h[1:] for h in halves)])
    return c


class Graph:
    """Neighbour graph over centroids: each one's nearest, and a ring that keeps it connected."""

    def __init__(self, centroids: np.ndarray):
        self.c, k = centroids, len(centroids)
        degree = min(DEGREE, max(1, k - 1))
        near = np.argsort(squared(centroids, centroids), axis=1, kind="stable")[:, 1 : degree + 1] if k > 1 else np.zeros((1, 1), dtype=np.int64)
        ring = (np.arange(k)[:, None] + np.array([1, max(1, k // 3)])) % k
        self.links = np.concatenate([near, ring], axis=1)
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))

    def search(self, x: np.ndarray, beam: int = BEAM, ratio: float = 0.0) -> np.ndarray:
        """Distances to the centroids that a best-first walk meets, infinite elsewhere; it walks on from the beam nearest and from all within ratio of the nearest."""
        n, k = len(x), len(self.c)
        found = np.full((n, k), np.inf)
        found[:, self.entries] = np.sqrt(squared(x, self.c[self.entries]))
        walked = np.zeros((n, k), dtype=bool)
        rows = np.arange(n)
        beam = min(beam, k)
        while len(rows):
            open_ = np.where(walked[rows], np.inf, found[rows])
            some = np.argpartition(open_, min(3, k - 1), axis=1)[:, :4]
            limit = np.maximum(np.partition(found[rows], beam - 1, axis=1)[:, beam - 1], ratio * found[rows].min(1))
            best = np.take_along_axis(open_, some, 1)
            use = np.isfinite(best) & (best <= limit[:, None])
            rows, some, use = rows[use.any(1)], some[use.any(1)], use[use.any(1)]
            at, which = np.nonzero(use)
            from_, node = rows[at], some[at, which]
            walked[from_, node] = True
            q = np.repeat(from_, self.links.shape[1])
            to = self.links[node].reshape(-1)
            fresh = np.isinf(found[q, to])
            q, to = q[fresh], to[fresh]
            found[q, to] = np.sqrt(np.maximum(((x[q] - self.c[to]) ** 2).sum(1), 0))
        return found


class Lists:
    def __init__(self, centroids: np.ndarray):
        self.graph = Graph(centroids)
        self.between = np.sqrt(squared(centroids, centroids))
        self.ratio, self.spread = 1.0, SPREADS[0]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every vector's lists."""
        d = self.graph.search(x, 16)
        n = min(4 * COPIES, d.shape[1])
        order = np.argsort(d, axis=1, kind="stable")[:, :n]
        near = np.take_along_axis(d, order, 1)
        chosen = np.zeros((len(x), n), dtype=bool)
        chosen[:, 0] = True
        for j in range(1, n):
            fits = (near[:, j] <= BOUNDARY * near[:, 0]) & (chosen.sum(1) < COPIES)
            for i in range(j):  # not if a chosen centroid is closer to it than `spread` of the vector's distance
                fits &= ~(chosen[:, i] & (self.between[order[:, i], order[:, j]] < self.spread * near[:, j]))
            chosen[:, j] = fits
        row, at = np.nonzero(chosen)
        return row, order[row, at]

    def calibrate(self, x: np.ndarray, k: int) -> None:
        """Sets spread and ratio on sampled vectors and their true neighbours among them: of the spreads the one by which RECALL costs the fewest vectors visited."""
        r = np.random.default_rng(5)
        q = x[np.sort(r.choice(len(x), min(TRIALS, len(x)), replace=False))]
        true = np.argsort(squared(q, x), axis=1, kind="stable")[:, 1 : k + 1]
        d = np.sqrt(squared(q, self.graph.c))
        d /= np.maximum(d.min(1, keepdims=True), 1e-12)
        found = []
        for spread in SPREADS:
            self.spread = spread
            row, of = (np.concatenate(a) for a in zip(*((row + lo, of) for lo in range(0, len(x), BATCH) for row, of in [self.assign(x[lo : lo + BATCH])]), strict=True))
            bounds = np.searchsorted(row, np.arange(len(x) + 1))
            needed = [d[i, of[bounds[t] : bounds[t + 1]]].min() for i, some in enumerate(true.tolist()) for t in some]
            ratio = float(np.quantile(needed, RECALL)) if needed else 1.0
            found.append((float(((d <= ratio) @ np.bincount(of, minlength=d.shape[1])).mean()), -spread, ratio))
        _, spread, self.ratio = min(found)
        self.spread = -spread

    def visit(self, q: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query row, its lists)."""
        for lo in range(0, len(q), BATCH):
            d = self.graph.search(q[lo : lo + BATCH], BEAM, self.ratio)
            for i, row in enumerate(d):
                order = np.argsort(row, kind="stable")
                order = order[np.isfinite(row[order])]
                n = int(np.searchsorted(row[order], self.ratio * row[order[0]], side="right"))
                have = np.cumsum(sizes[order]) / COPIES
                n = max(n, int(np.searchsorted(have, least)) + 1)
                if n > len(order):  # the walk met too few: all lists
                    order = np.arange(len(row))
                yield lo + i, order[:n]


# Spark ------------------------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(cid, ids, v): equal vectors with their k + 1 smallest ids; the limit holds before the shuffle too."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", 0).alias("cid"), "ids", "v")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def top(q: np.ndarray, v: np.ndarray, ids: list[list[int]], k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """(query row, its k nearest ids of a block with distance), by exact distance, then id."""
    for lo in range(0, len(q), 256):
        rough = squared(q[lo : lo + 256], v)
        n = min(k, len(v))
        bound = np.partition(rough, n - 1, axis=1)[:, n - 1]
        slack = 1e-9 * (1 + (q[lo : lo + 256] ** 2).sum(1) + (v * v).sum(1).max())
        for i, row in enumerate(rough):
            near = np.nonzero(row <= bound[i] + slack[i])[0]
            exact = np.sqrt(((q[lo + i] - v[near]) ** 2).sum(1))
            found = sorted((d, name) for d, j in zip(exact.tolist(), near.tolist(), strict=True) for name in ids[j])
            yield lo + i, found[:k]


def neighbours(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows of vectors where `queries` holds of the id column `id`, the nearest k others found."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors, id_col, vector_col)
    groups = materialised(classes_of(rows, k), "classes")
    n = groups.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    sample = np.array([r["v"] for r in groups.orderBy(F.xxhash64("v"), "cid").limit(SAMPLE).select("v").collect()], dtype=np.float64)
    lists = Lists(balanced_centroids(sample, int(np.clip(n // LIST, 1, min(MOST_LISTS, -(-len(sample) // 8))))))
    lists.calibrate(sample, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                row, of = lists.assign(matrix(part.column(2)))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), *taken.columns], names=["list", "cid", "ids", "v"])

    v_type = dict(groups.dtypes)["v"]
    posted = materialised(groups.mapInArrow(assign, f"list int, cid long, ids array<long>, v {v_type}"), "postings")
    sizes = np.zeros(len(lists.graph.c), dtype=np.int64)
    for r in posted.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // BLOCK))
    n_blocks = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("list") + 1) if (blocks > 1).any() else F.lit(1)
    posted = posted.withColumn("block", F.pmod(F.xxhash64("cid"), n_blocks).cast("int"))

    asked = rows.where(queries)
    leads = materialised(asked.groupBy("v").agg(F.min("id").alias("qid")).select("qid", "v"), "queries")

    turns = max(1, -(-leads.count() // QUERY_BLOCK))
    if turns > 1:  # every query may visit a list: its blocks meet so many shares of the queries
        posted = posted.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    else:
        posted = posted.withColumn("turn", F.lit(0))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                at = [(i, j, b) for i, some in lists.visit(matrix(part.column(1)), sizes, k + 1) for j in some.tolist() for b in range(int(blocks[j]))]
                if at:
                    i, j, b = zip(*at, strict=True)
                    taken = part.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(b, pa.int32()), *taken.columns], names=["list", "block", "qid", "v"])

    visits = leads.mapInArrow(visit, f"list int, block int, qid long, v {v_type}")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            post, ask = left.combine_chunks(), right.combine_chunks()
            names = ask["qid"].to_pylist()
            v, q = (matrix(t["v"].combine_chunks() if hasattr(t["v"], "combine_chunks") else t["v"]) for t in (post, ask))
            for i, found in top(q, v, post["ids"].to_pylist(), k + 1):
                out += [(names[i], name, d) for d, name in found]
        qid, vec, dist = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"qid": pa.array(qid, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(dist, pa.float64())})

    visits = visits.withColumn("turn", F.pmod(F.xxhash64("qid"), F.lit(turns)).cast("int"))
    met = posted.groupBy("list", "block", "turn").cogroup(visits.groupBy("list", "block", "turn")).applyInArrow(compare, "qid long, vec_id long, score double")
    best = met.groupBy("qid", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))
    best = materialised(best.withColumn("_n", place).where(F.col("_n") <= k + 1).drop("_n"), "best")
    owners = asked.join(leads, "v").select(F.col("id").alias("query_id"), "qid").distinct()
    pairs = owners.join(best, "qid").where("query_id <> vec_id")
    final = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return final.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every hundredth vector."""
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)
