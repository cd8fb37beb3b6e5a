"""Approximate nearest neighbours: inverted lists with an adaptive scan of rotated dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import bound_batches, checkpoint, release

#: The index is fitted on so many vectors at most, of so many bytes together.
SAMPLE, SAMPLE_BYTES = 20_000, 16 << 20
MOST_LISTS, BLOCK_DIMS, BLOCK_ROWS = 4096, 16, 4096
#: Share of the sample's own neighbours that the probed lists must hold, and vectors of the sample that this is measured on.
RECALL, TRIALS = 0.98, 400
#: Width of the test that abandons a candidate: at t of D dimensions its distance must exceed the limit by 1 + EPSILON / sqrt(t).
EPSILON = 2.1
#: Rounding allowed to a squared distance, as a share of both vectors' squared norms; pairs measured at once.
SLACK, PAIRS = 1e-12, 65_536


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, by their products (rounded)."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)


def squares(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs of rows (a[i], b[j])."""
    out = np.empty(len(i))
    for lo in range(0, len(i), PAIRS):
        out[lo : lo + PAIRS] = ((a[i[lo : lo + PAIRS]] - b[j[lo : lo + PAIRS]]) ** 2).sum(1)
    return out


class Index:
    """What is fitted on the sample: lists' centres, a rotation, how many lists to probe, and the sample itself."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, lists: int, k: int, seed: int = 7, rounds: int = 8):
        rng = np.random.default_rng(seed)
        ids, first = np.unique(ids, return_index=True)
        self.ids, self.sample, self.k = ids, sample[first], k
        sample = self.sample
        distinct = np.unique(sample, axis=0)
        self.centres = distinct[rng.permutation(len(distinct))[:lists]].copy()
        for _ in range(rounds):
            own = self.nearest_list(sample)[0]
            total, n = np.zeros_like(self.centres), np.bincount(own, minlength=len(self.centres))
            np.add.at(total, own, sample)
            self.centres[n > 0] = total[n > 0] / n[n > 0, None]
        self.rotation = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))[0]
        self.probes = self.measured(rng)

    def nearest_list(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, squared distance of its centre) of each row."""
        own, far = np.empty(len(x), np.int64), np.empty(len(x))
        for a in range(0, len(x), 4096):
            d = squared(x[a : a + 4096], self.centres)
            own[a : a + 4096] = d.argmin(1)
            far[a : a + 4096] = d.min(1)
        return own, far

    def neighbours(self, q_id: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the sample nearest to each query, k of them at most and never of its own id, and their squared distances."""
        d = squared(q, self.sample)
        d[q_id[:, None] == self.ids] = np.inf
        many = min(self.k, len(self.ids))
        found = np.argpartition(d, many - 1, axis=1)[:, :many] if many else np.zeros((len(q), 0), np.int64)
        exact = ((q[:, None, :] - self.sample[found]) ** 2).sum(2)
        exact[~np.isfinite(np.take_along_axis(d, found, 1))] = np.inf
        return found, exact

    def measured(self, rng: np.random.Generator) -> int:
        """The fewest nearest lists that hold the share RECALL of the sample's own neighbours, over TRIALS rows of it.

        In the whole table neighbours are nearer than in the sample, so this errs to more lists.
        """
        some = rng.permutation(len(self.ids))[:TRIALS]
        self.own, ranks = self.nearest_list(self.sample)[0], []
        for a in range(0, len(some), 64):
            q = self.sample[some[a : a + 64]]
            found, exact = self.neighbours(self.ids[some[a : a + 64]], q)
            place = np.argsort(np.argsort(squared(q, self.centres), axis=1, kind="stable"), axis=1)
            ranks.append(np.take_along_axis(place, self.own[found], 1)[np.isfinite(exact)])
        ranks = np.sort(np.concatenate([np.zeros(0, np.int64), *ranks]))
        return int(ranks[int(np.ceil(RECALL * len(ranks))) - 1]) + 1 if len(ranks) else len(self.centres)

    def probed(self, q: np.ndarray, limit: np.ndarray, found: np.ndarray, far: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether each query looks into each list: ``probes`` nearest ones, more until they hold over k rows, those of its ``found``.

        No list is looked into whose nearest possible row (the centre's distance less the list's radius) is
        farther than the query's limit; a query without limit looks into all.
        """
        d = squared(q, self.centres)
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(rows[order], axis=1) - rows[order]  # rows in the nearer lists
        near = np.zeros(d.shape, bool)
        np.put_along_axis(near, order, (np.arange(len(self.centres)) < self.probes) | (held <= self.k), 1)
        np.put_along_axis(near, self.own[found], True, 1)
        near |= np.isinf(limit)[:, None]
        slack = 1e-9 * (np.sqrt((q**2).sum(1))[:, None] + np.sqrt((self.centres**2).sum(1)) + 1e-300)
        return near & (rows > 0) & (np.sqrt(d) - far - slack <= np.sqrt(limit)[:, None])


def scan(q_id: np.ndarray, q: np.ndarray, limit: np.ndarray, x_id: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of one list for each query: exact distances for what the tests leave.

    Squared distances grow by column blocks of the rotated vectors. A query's limit (squared) is the one it
    brings, or the k-th smallest exact distance of the candidates that look best after the first block; these
    are always kept. Rotated distances are rounded, so a limit of 0 (copies of the query) still lets rounding
    through. Of equal candidates only the k + 1 smallest ids can be among the nearest; the others are left.
    """
    x = np.ascontiguousarray(x)
    same = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((x_id, same))
    order = order[np.concatenate([[True], (np.diff(same[order]) != 0) | (np.diff(x_id[order]) != 0)])]
    copy = np.arange(len(order)) - np.searchsorted(same[order], same[order])
    kept = order[copy <= k]
    x_id, x = x_id[kept], x[kept]
    repeated = len(np.unique(x_id)) < len(x_id)
    parts = []
    rq, rx, dims = q @ rotation, x @ rotation, q.shape[1]
    q_norm, x_norm = (q**2).sum(1), (x**2).sum(1)
    for a in range(0, len(q), 256):
        rows, block = slice(a, a + 256), slice(0, BLOCK_DIMS)
        partial = squared(rq[rows, block], rx[:, block])
        partial[q_id[rows][:, None] == x_id[None, :]] = np.inf
        look = min(k, len(x_id))
        first = np.argpartition(partial, look - 1, axis=1)[:, :look]
        exact = ((q[rows][:, None, :] - x[first]) ** 2).sum(2)
        exact[~np.isfinite(np.take_along_axis(partial, first, 1))] = np.inf
        most = np.minimum(limit[rows], exact.max(1)) if look == k and not repeated else limit[rows]
        t = min(BLOCK_DIMS, dims)
        slack = SLACK * (q_norm[rows][:, None] + x_norm)
        looked = np.zeros(partial.shape, bool)
        np.put_along_axis(looked, first, True, 1)
        i, j = np.nonzero(looked | ((partial - slack) * (dims / t) <= (most * (1 + EPSILON / np.sqrt(t)) ** 2)[:, None]))
        so_far = partial[i, j]
        keep = np.isfinite(so_far)
        i, j, so_far = i[keep], j[keep], so_far[keep]
        while t < dims:
            block = slice(t, t + BLOCK_DIMS)
            so_far = so_far + squares(rq[rows, block], i, rx[:, block], j)
            t = min(t + BLOCK_DIMS, dims)
            keep = looked[i, j] | ((so_far - slack[i, j]) * (dims / t) <= most[i] * (1 + EPSILON / np.sqrt(t)) ** 2)
            i, j, so_far = i[keep], j[keep], so_far[keep]
        d = squares(q[rows], i, x, j)
        if repeated:
            order = np.lexsort((d, x_id[j], i))
            order = order[np.concatenate([[True], (np.diff(i[order]) != 0) | (np.diff(x_id[j[order]]) != 0)])] if len(order) else order
            i, j, d = i[order], j[order], d[order]
        order = np.lexsort((x_id[j], d, i))
        i, j, d = i[order], j[order], d[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        parts.append(pd.DataFrame({"query_id": q_id[rows][i[top]], "vec_id": x_id[j[top]], "score": np.sqrt(d[top])}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(vectors: DataFrame, is_query: Column, k: int = 10, lists: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest rows found for every query row.

    vectors: (vec_id, embedding). Null, zero, empty, non-finite vectors, vectors holding nulls, rows with null
    vec_id, and vectors whose length isn't the table's commonest take no part; nor do they ask. Euclidean
    distance in double precision on the original values; equal distances go by the smaller vec_id. A query
    never finds its own row (any row of its id). Rows that repeat a vec_id are one candidate, at its smallest
    distance. Fewer candidates than k give all of them; an empty table gives no rows.

    Every row is indexed. A query's limit is the k-th smallest exact distance within the fitted sample, whose
    rows are candidates as well; it goes with the query into each list it probes. How many lists that is
    follows from RECALL on the sample. Large lists are split by a hash on both sides, so that no task holds
    more than about BLOCK_ROWS of each.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    lengths = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = lengths[0]["d"], lengths[0]["n"]
    v = v.where(F.size("v") == dims)
    lists = lists or int(min(MOST_LISTS, max(1, 2 ** round(np.log2(np.sqrt(n) / 2 + 1)))))
    size = max(min(SAMPLE, SAMPLE_BYTES // (8 * dims)), 2 * k)
    rate = min(1.0, 1.1 * size / n)
    drawn = v.where(F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 30)) <= F.lit(int(rate * (1 << 30)))).select("vec_id", "v").limit(size).toArrow()
    index = Index(drawn["vec_id"].to_numpy(), np.asarray(drawn["v"].combine_chunks().flatten()).reshape(-1, dims), lists, k)
    lists = len(index.centres)

    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column(0).to_numpy(), np.asarray(batch.column(1).flatten()).reshape(-1, dims)

    def place(batches):
        for b in batches:
            own, far = index.nearest_list(rows_of(b)[1])
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.sqrt(far)), *b.columns[:2]], names=["list", "far", "vec_id", "v"])
        release()

    x = checkpoint(v.select("vec_id", "v").mapInArrow(place, "list int, far double, vec_id long, v array<double>"))
    measured = x.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row for each list: MOST_LISTS at most
    rows, far = np.zeros(lists, np.int64), np.zeros(lists)
    for r in measured:
        rows[r["list"]], far[r["list"]] = r["n"], r["far"]

    def ask(batches):
        """A query's row for each list it probes, with its limit; the sample's neighbours are rows of list -1."""
        for b in batches:
            q_id, q = rows_of(b)
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                found, exact = index.neighbours(q_id[a : a + 256], part)
                limit = exact.max(1) if found.shape[1] == k else np.full(len(part), np.inf)
                i, which = np.nonzero(index.probed(part, limit, found, far, rows))
                si, sj = np.nonzero(np.isfinite(exact))
                at = pa.array(np.concatenate([a + i, a + si]))
                near = np.concatenate([np.zeros(len(i), np.int64), index.ids[found[si, sj]]])
                limit = np.concatenate([limit[i], exact[si, sj]])
                which = np.concatenate([which, np.full(len(si), -1)]).astype(np.int32)
                vectors = b.column(1).take(at) if not len(si) else pa.concat_arrays([b.column(1).take(at[: len(i)]), pa.nulls(len(si), b.column(1).type)])
                yield pa.RecordBatch.from_arrays([pa.array(which), b.column(0).take(at), vectors, pa.array(limit), pa.array(near)], names=["list", "vec_id", "v", "limit", "near"])
        release()

    asked = checkpoint(v.where("asks").select("vec_id", "v").mapInArrow(ask, "list int, vec_id long, v array<double>, limit double, near long"))
    sampled = asked.where("list = -1").select(F.col("vec_id").alias("query_id"), F.col("near").alias("vec_id"), F.sqrt("limit").alias("score"))
    q = asked.where("list >= 0").select("list", "vec_id", "v", "limit")
    parts = {r["list"]: -(-r["n"] // BLOCK_ROWS) for r in q.groupBy("list").agg(F.count("*").alias("n")).collect()}
    nx = long_map(spark, {k: -(-int(n) // BLOCK_ROWS) for k, n in enumerate(rows) if n and k in parts})
    nq = long_map(spark, parts)
    splits = F.broadcast(nx.withColumnRenamed("n", "nx").join(nq.withColumnRenamed("n", "nq"), "list"))  # a row for each list: MOST_LISTS at most
    side = lambda d, own, other: d.join(splits, "list").withColumn("mine", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(own)).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    x = side(x, "nx", "nq").select("list", F.col("mine").alias("bx"), F.col("theirs").alias("bq"), "vec_id", "v")
    q = side(q, "nq", "nx").select("list", F.col("theirs").alias("bx"), F.col("mine").alias("bq"), "vec_id", "v", "limit")

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return scan(left["vec_id"].to_numpy(), np.stack(left["v"]), left["limit"].to_numpy(), right["vec_id"].to_numpy(), np.stack(right["v"]), index.rotation, k)

    keys = ["list", "bx", "bq"]
    found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(block, "query_id long, vec_id long, score double")
    found = found.union(sampled).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def long_map(spark, values: dict[int, int]) -> DataFrame:
    return spark.createDataFrame([(int(k), int(n)) for k, n in values.items()], "list int, n int")
