"""Approximate nearest neighbours by cosine: inverted lists with an adaptive dimension scan.

Vectors are scaled to length one, turned by a random rotation and kept in column blocks. Lists belong to centroids
fitted on a bounded sample, of PER_LIST vectors each on average: where there must be more lists than a sample can
bear, each is cut by a second set of centroids that all lists share, fitted on what the first leaves. Every vector is
indexed, in blocks of bounded size, so that a list with a third of all vectors is many tasks; the queries of a list
are cut into blocks too.

A query first scans its nearest list, which gives it a bound; then its other lists, as many as find COVERAGE of the
neighbours within the sample. Within a block the first column block gives partial distances to all rows; the rows of
the smallest ones tighten the bound, then partial distances over one column block after another are tested against
it, and a candidate is given up once the distance estimated from d of D dimensions, less an error of EPSILON / sqrt(d),
lies beyond the bound. Survivors get the exact cosine of the original vectors in double precision.

Defined edge cases: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components take no part as queries or candidates; ties go to the smaller id; rows without an id take no part;
repeated rows are candidates of their own, except that a query's own id is never its neighbour; with fewer candidates
than k all found are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K = 5
#: Vectors that centroids are fitted on, at most; sampled vectors for each centroid of a set, at least.
SAMPLE, PER_CENTROID = 20_000, 8
#: Aimed vectors in a list; lists that a query probes at least.
PER_LIST, PROBES = 512, 16
#: Share of the sample's true neighbours whose lists must be probed, and how many sampled queries measure that.
COVERAGE, MEASURED = 0.97, 400
#: Rows of one block of a list, queries of one block, and queries whose partial distances are held at once.
BLOCK, QUERIES, TOGETHER = 2048, 2048, 128
#: Dimensions of a column block, and the factor of the test's error bound.
STEP, EPSILON = 16, 2.1


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _means(sample: np.ndarray, count: int, sphere: bool, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means centroids, on the sphere or not; empty clusters keep theirs."""
    distinct = np.unique(sample, axis=0)
    centroids = distinct[np.random.default_rng(seed).choice(len(distinct), min(count, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = (sample @ centroids.T - (0 if sphere else (centroids**2).sum(axis=1) / 2)).argmax(axis=1)
        total, n = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))[:, None]
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True) if sphere else n
        centroids = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centroids)
    return centroids


class Lists:
    """Centroids of two levels; list number = number of the first * number of second ones + number of the second."""

    def __init__(self, sample: np.ndarray, n: int):
        most = max(1, len(sample) // PER_CENTROID)
        wanted = max(1, n // PER_LIST)
        self.first = _means(sample, min(wanted, most), True)
        self.second = np.zeros((1, sample.shape[1]))
        if wanted > most:
            left = sample - self.first[(sample @ self.first.T).argmax(axis=1)]
            self.second = _means(left, min(-(-wanted // most), most), False)
        self.count = len(self.first) * len(self.second)

    def _second(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Squared distances, but for |x|, to the centroids of all lists that each row's first centroid is cut into."""
        c = self.first[first]
        return ((self.second**2).sum(axis=1) + 2 * c @ self.second.T + (c**2).sum(axis=1)[:, None]) - 2 * (x @ self.second.T + (x * c).sum(axis=1)[:, None])

    def assign(self, x: np.ndarray) -> np.ndarray:
        own = (x @ self.first.T).argmax(axis=1)
        return own * len(self.second) + self._second(x, own).argmin(axis=1)

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each row, nearest first: of the first centroids that hold four times as many."""
        near = x @ self.first.T
        some = min(len(self.first), -(-(4 if len(self.second) > 1 else 1) * probes // len(self.second)))
        top = np.argsort(-near, axis=1, kind="stable")[:, :some]
        rows = np.repeat(np.arange(len(x)), some)
        apart = self._second(x[rows], top.ravel()).reshape(len(x), -1)
        cells = (top[:, :, None] * len(self.second) + np.arange(len(self.second))).reshape(len(x), -1)
        order = np.argsort(apart, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(cells, order, axis=1)


def probes_for(sample: np.ndarray, lists: Lists, k: int) -> int:
    """Lists to probe so that COVERAGE of the sample's own nearest neighbours are found. Among all vectors neighbours
    are nearer than in a sample, so this errs to the safe side."""
    n = min(k, len(sample) - 1)
    if n < 1:
        return lists.count
    own, need = lists.assign(sample), []
    for i in range(min(MEASURED, len(sample))):
        near = sample @ sample[i]
        near[i] = -9
        best = np.argpartition(-near, n - 1)[:n]
        rank = np.empty(lists.count, np.int64)
        rank[lists.nearest(sample[i : i + 1], lists.count)[0]] = np.arange(lists.count)
        need += rank[own[best]].tolist()
    return int(min(lists.count, max(PROBES, math.ceil(np.quantile(need, COVERAGE)) + 1)))


def scan(block: np.ndarray, ids: np.ndarray, exact: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, query_exact: np.ndarray, bounds: np.ndarray, k: int) -> tuple[list[tuple[int, int, float]], int]:
    """(query, id, cosine) of each query's best k rows of a block, and how many values of vectors were read. block,
    queries: rotated; exact: original, scaled; bounds: squared distances beyond which no row of a query counts."""
    dim, out, read = block.shape[1], [], 0
    head = min(STEP, dim)
    steps = [*range(2 * STEP, dim, STEP), dim] if dim > head else []
    size = (block[:, :head] ** 2).sum(axis=1)
    for a in range(0, len(queries), TOGETHER):
        some = queries[a : a + TOGETHER, :head]
        parts = np.maximum((some**2).sum(axis=1)[:, None] + size - 2 * some @ block[:, :head].T, 0)
        read += parts.size * head
        for i, part in enumerate(parts, a):
            q, qid, qx = queries[i], query_ids[i], query_exact[i]
            part[ids == qid] = np.inf
            first = np.argpartition(part, min(4 * k, len(part)) - 1)[: 4 * k]
            first = first[ids[first] != qid]
            bound = bounds[i]
            if len(first) >= k:
                whole = ((block[first] - q) ** 2).sum(axis=1)
                bound = min(bound, np.partition(whole, k - 1)[k - 1])
            read += len(first) * (dim - head)
            limit = bound * (head / dim) * (1 + EPSILON / math.sqrt(head)) ** 2 if steps else bound * (1 + 1e-6) + 1e-9
            part[first] = np.inf  # known already
            live = np.flatnonzero((part <= limit) & (ids != qid) & np.isfinite(part))
            sums, d0 = part[live], head
            for d1 in steps:
                diff = block[live, d0:d1] - q[d0:d1]
                sums = sums + (diff * diff).sum(axis=1)
                read += diff.size
                # Partial distances, scaled to all dimensions, against the bound with the test's error.
                keep = sums <= bound * (d1 / dim) * (1 + EPSILON / math.sqrt(d1)) ** 2 if d1 < dim else sums <= bound * (1 + 1e-6) + 1e-9
                live, sums, d0 = live[keep], sums[keep], d1
            live = np.concatenate([first, live])
            score = (exact[live] * qx).sum(axis=1)
            best = np.lexsort((ids[live], -score))[:k]
            out += [(qid, int(ids[live[j]]), float(score[j])) for j in best]
    return out, read


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` found for each row of `queries`."""
    spark = vectors.sparkSession
    base, asked = _valid(vectors, id_col, vector_col), _valid(queries, id_col, vector_col)
    out = "query_id long, vec_id long, score double"
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes["d"], sizes["count"]
    base, asked = base.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    rows = base.select("v").orderBy(F.xxhash64("v", "id")).limit(SAMPLE).toArrow().column("v").combine_chunks()
    turn = rotation(dim)
    fitted_on = unit(rows.flatten().to_numpy().reshape(-1, dim)) @ turn
    lists = Lists(fitted_on, n)
    probes = probes_for(fitted_on, lists, k)
    shared = spark.sparkContext.broadcast((turn, lists))

    def assign(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn, lists = shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    x = unit(part.column(1).flatten().to_numpy().reshape(-1, dim)) @ turn
                    best = lists.nearest(x, probes) if probes else lists.assign(x)[:, None]
                    at = np.arange(0, best.size + 1, best.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(best.ravel().astype(np.int64)))], names=["id", "v", "lists"])

        return run

    schema = "id long, v array<double>, lists array<long>"
    indexed = common.map_arrow(base, assign(0), schema).select("id", "v", F.col("lists")[0].alias("list"))
    probing = common.materialise(common.map_arrow(asked, assign(probes), schema).select("id", "v", F.posexplode("lists").alias("nth", "list")))
    blocks = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    asking = probing.groupBy("list").agg(F.ceil(F.sum((F.col("nth") > 0).cast("long")) / QUERIES).alias("turns"), F.ceil(F.sum((F.col("nth") == 0).cast("long")) / QUERIES).alias("turns0"))
    sizes = common.materialise(blocks.join(asking, "list"))
    # A list's rows are dealt over its blocks, its queries over turns; every block meets every turn.
    dealt = common.materialise(indexed.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))).drop("blocks"))

    def meet(asked: DataFrame, turns: str) -> DataFrame:
        """asked: id, v, list, bound; turns: the column with the number of the list's blocks of queries."""
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = dealt.where(F.col(turns) > 0).select("list", "block", "id", "v", upto(turns).alias("turn"))
        right = asked.join(sizes.select("list", "blocks", turns), "list").withColumn("turn", F.pmod(F.xxhash64("id", F.lit(2)), F.col(turns)))
        right = right.select("list", "turn", "id", "v", "bound", upto("blocks").alias("block"))

        def pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            turn, _ = shared.value
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            left = left.sort_values("id", kind="stable")
            exact, asked = unit(np.stack(left["v"])), unit(np.stack(right["v"]))
            found, _ = scan(exact @ turn, left["id"].to_numpy(), exact, asked @ turn, right["id"].to_numpy(), asked, right["bound"].to_numpy(), k)
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

        keys = ["list", "block", "turn"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pairs, out)

    # The nearest list gives each query a bound: the squared distance of its k-th row, if it has so many.
    near = best_k(meet(probing.where("nth = 0").withColumn("bound", F.lit(float("inf"))), "turns0"), k)
    near = common.materialise(near)
    bounds = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), (2.0 - 2.0 * F.col("score") + 1e-9).alias("bound"))
    others = probing.where("nth > 0").join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return best_k(near.drop("rank").unionByName(meet(others.select("id", "v", "list", "bound"), "turns")), k)


def best_k(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
