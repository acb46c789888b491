"""Exact top-k inner-product search: ball trees over shards, branch and bound.

Vectors are dealt to clusters around at most `most_clusters` centres, which are fitted on a bounded sample (16 vectors for each
centre; it decides how much is searched, not what is found), and a cluster of more than `shard_rows` vectors to several shards.
In a shard a ball tree (centres and radii, split at the median along the direction of largest spread) gives every node
an upper bound for a query's inner products, q . centre + |q| radius; nodes are opened in the order of their
bounds until none exceeds the query's kth score.

That score is shared between shards: a query is first searched in one shard of the cluster of the highest bound; the kth score
found there is its floor, and it is then sent only to shards of clusters whose bound reaches the floor. The table of
clusters (a centre and a radius each) is bounded by `most_clusters`, so tasks that route queries hold it whole.

Scores are exact: floats where no sum can reach 2**53, else 64-bit integers, and Python integers where those could overflow. Queries
stream past a shard's tree in blocks, so a task holds one shard and one block.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, neither as query
nor as candidate; so do those whose scaled components are beyond a double. Only vectors of equal length are compared; a score
beyond 64 bits is returned as the nearest number of 64 bits; ties go to the smaller id; a query's own row is no candidate, but
other rows with an equal id are; queries with no candidate have no rows; very long vectors are handled whole; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import place, shared

_LEAF = 128
_BLOCK = 512
_TOP = (1 << 63) - 1
_ROUTED = "shard int, kind int, uid long, id long, v array<double>, floor long"


def _bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query and ball at least the inner product with any row in the ball; room for rounding is added."""
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((q * q).sum(1))[:, None]
        reach = length * radius[None, :]
        b = q @ centre.T + reach + 1e-9 * (length * np.sqrt((centre * centre).sum(1))[None, :] + reach) + 1e-9
    return np.where(np.isnan(b), np.inf, b)


class BallTree:
    """Nodes in arrays; leaves hold consecutive rows of a permutation."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        self.lo, self.hi, self.left, centre, radius = [], [], [], [], []
        todo = [(0, len(x), -1)]
        self.right = []
        with np.errstate(over="ignore", invalid="ignore"):
            while todo:
                lo, hi, parent = todo.pop()
                node = len(self.lo)
                own = x[self.order[lo:hi]]
                c = own.mean(0)
                centre.append(c)
                radius.append(float(np.sqrt(((own - c) ** 2).sum(1).max(initial=0))))
                self.lo.append(lo)
                self.hi.append(hi)
                self.left.append(-1)
                self.right.append(-1)
                if parent >= 0:
                    if self.left[parent] < 0:
                        self.left[parent] = node
                    else:
                        self.right[parent] = node
                if hi - lo > _LEAF and 0 < radius[-1] < np.inf:
                    far = own[((own - c) ** 2).sum(1).argmax()]
                    other = own[((own - far) ** 2).sum(1).argmax()]
                    mid = (hi - lo) // 2
                    self.order[lo:hi] = self.order[lo:hi][np.argpartition(own @ (other - far), mid)]
                    todo += [(lo + mid, hi, node), (lo, lo + mid, node)]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.sorted = x[self.order]
        self.largest = float(np.abs(x).max(initial=0))
        self.exact: dict[type, np.ndarray] = {}

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return _bounds(q, self.centre, self.radius)

    def kind(self, largest: float) -> type:
        """The numbers in which inner products with queries of components up to largest are exact."""
        most = (int(self.largest) + 1) * (int(largest) + 1) * max(self.x.shape[1], 1)
        return float if most < 1 << 53 else np.int64 if most < 1 << 63 else object

    def rows(self, kind: type) -> np.ndarray:
        if kind is float:
            return self.sorted
        if kind not in self.exact:
            self.exact[kind] = exactly(self.sorted, kind)
        return self.exact[kind]

    def search(self, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, own: int, k: int, floor: int | None, kind: type = float) -> list[tuple[int, int]]:
        """The (score, id) of the k best rows other than number own that score floor or more."""
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        heap = [(-bound[0], 0)]
        data, q = self.rows(kind), exactly(q, kind)
        least = -np.inf if floor is None else floor
        while heap:
            b, node = heapq.heappop(heap)
            if -b < least:
                break
            if self.left[node] < 0:
                lo, hi = self.lo[node], self.hi[node]
                score = data[lo:hi] @ q
                for j in np.flatnonzero(score >= least):
                    row = self.order[lo + j]
                    if row == own:
                        continue
                    x = (int(score[j]), -int(ids[row]))
                    if len(best) < k:
                        heapq.heappush(best, x)
                    elif x > best[0]:
                        heapq.heapreplace(best, x)
                if len(best) == k:
                    least = max(least, best[0][0])
            else:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (-bound[child], child))
        return [(s, -i) for s, i in best]


def exactly(x: np.ndarray, kind: type) -> np.ndarray:
    """Doubles that hold integers, as numbers of the kind."""
    if kind is object:
        return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return x.astype(kind)


def _flat(batch: pa.RecordBatch, j: int) -> np.ndarray:
    """Vectors of a batch, all of one length, as a matrix."""
    return batch.column(j).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, its vectors (kind 0) before the queries (kind 1)."""
        shard, ids, vectors, uids, tree = None, [], [], [], None
        wait: list[tuple] = []

        def flush():
            nonlocal tree
            if not wait or not ids:
                wait.clear()
                return
            if tree is None:
                tree = BallTree(np.array(vectors, float)), np.array(ids, np.int64), {u: n for n, u in enumerate(uids)}
            t, own_ids, place_of = tree
            q = np.array([w[2] for w in wait], float)
            b, kind = t.bounds(q), t.kind(float(np.abs(q).max(initial=0)))
            rows = [(w[0], w[1], i, max(-_TOP, min(_TOP, s))) for n, w in enumerate(wait) for s, i in t.search(q[n], b[n], own_ids, place_of.get(w[0], -1), k, w[3], kind)]
            wait.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], names=["quid", "query_id", "vec_id", "score"])

        for batch in batches:
            x = _flat(batch, 4) if len(batch) else []
            for n, (s, kind, uid, i, floor) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 1, 2, 3, 5)), strict=True)):
                if s != shard:
                    yield from flush()
                    shard, ids, vectors, uids, tree = s, [], [], [], None
                if kind == 0:
                    ids.append(i)
                    uids.append(uid)
                    vectors.append(x[n])
                else:
                    wait.append((uid, i, x[n], floor))
                    if len(wait) == _BLOCK:
                        yield from flush()
        yield from flush()

    return run


def fit_centres(x: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n centres (or fewer) of the vectors of a sample, by a few rounds of nearest centres and their means."""
    c = np.unique(x[:n], axis=0)
    for _ in range(rounds):
        near = _nearest(x, c)[0]
        size = np.bincount(near, minlength=len(c))
        c = np.stack([np.bincount(near, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], 1)[size > 0] / size[size > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and its distance."""
    near = np.zeros(len(x), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        half = (c * c).sum(1) / 2
        for lo in range(0, len(x), 2048):
            near[lo : lo + 2048] = (x[lo : lo + 2048] @ c.T - half).argmax(1)
        return near, np.sqrt(((x - c[near]) ** 2).sum(1))


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near, far = _nearest(_flat(batch, 3), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(far)], names=["uid", "id", "q", "v", "cluster", "far"])

    return run


def _route(centres: np.ndarray, radii: np.ndarray, first: np.ndarray, shards: np.ndarray, home: bool):
    """Sends queries (uid, id, v, floor, hash) to one shard of the best cluster (home), or to all others that may hold better rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                b = _bounds(_flat(part, 2), centres, radii)
                best, spread = b.argmax(1), part.column(4).to_numpy()
                own = first[best] + spread % shards[best]
                if home:
                    row, to = np.arange(len(part)), own
                else:
                    floor = np.array([-np.inf if x is None else x for x in part.column(3).to_pylist()], object)
                    row, cluster = np.nonzero(np.array([[x >= f for x in xs] for xs, f in zip(b.tolist(), floor, strict=True)], bool).reshape(b.shape))
                    n = shards[cluster]
                    to = np.repeat(first[cluster] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    row = np.repeat(row, n)
                    other = to != own[row]
                    row, to = row[other], to[other]
                for at in range(0, len(row), 4096):
                    r = pa.array(row[at : at + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(to[at : at + 4096].astype(np.int32)), pa.array(np.ones(len(r), np.int32)), *(part.column(j).take(r) for j in range(4))], names=["shard", "kind", "uid", "id", "v", "floor"])

    return run


def quantised(vector: str, factor: int = 256) -> Column:
    """floor(factor * component) of each component, as doubles that hold integers; null where the vector can't take part."""
    v = F.transform(F.col(vector), lambda x: F.lit(float(factor)) * x.cast("double"))
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(v, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)))


def top_k(rows: DataFrame, is_query: Column, vector: Column, k: int = 5, key: str = "vec_id", shard_rows: int = 8192, most_clusters: int = 1024) -> DataFrame:
    """query_id, rank, key and score of the k best rows for every query; vector: doubles that hold integers, null for rows that take no part."""
    spark = rows.sparkSession
    base = place(rows.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), vector.cast("array<double>").alias("v")), "uid")
    base = base.where(F.col("v").isNotNull() & (F.size("v") > 0)).select("uid", "id", "q", "v")
    dims = base.groupBy(F.size("v").alias("d")).count().collect()  # a row for each length of vectors
    schema = "quid long, query_id long, vec_id long, score long"
    found = None
    for d in dims:
        own, n = base.where(F.size("v") == d["d"]), -(-d["count"] // shard_rows)
        clusters = min(n, most_clusters)
        sample = own.select("v").orderBy(F.xxhash64("uid"), "uid").limit(16 * clusters).toArrow()["v"] if clusters > 1 else None
        centres = fit_centres(np.array(sample.to_pylist(), float), clusters) if clusters > 1 else np.zeros((1, d["d"]))
        dealt = shared(own.mapInArrow(_assign(centres), "uid long, id long, q boolean, v array<double>, cluster int, far double"), spark)
        size, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for r in dealt.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # a row for each cluster
            size[r["cluster"]], radii[r["cluster"]] = r["n"], r["far"] * (1 + 1e-9)
        shards = -(-size // shard_rows)
        first, total = np.cumsum(shards) - shards, int(shards.sum())
        info = spark.createDataFrame([(k_, int(a), int(m)) for k_, (a, m) in enumerate(zip(first, np.maximum(shards, 1), strict=True))], "cluster int, first int, parts int")
        spread = F.shiftrightunsigned(F.xxhash64("uid"), 1)
        vectors = dealt.join(F.broadcast(info), "cluster").select((F.col("first") + spread % F.col("parts")).cast("int").alias("shard"), F.lit(0).alias("kind"), "uid", "id", "v", F.lit(None).cast("long").alias("floor"))
        full = size > 0
        table = centres[full], radii[full], first[full], shards[full]

        def run(asked: DataFrame, total: int = total, vectors: DataFrame = vectors) -> DataFrame:
            both = vectors.unionByName(asked).repartition(total, "shard").sortWithinPartitions("shard", "kind")
            return both.mapInArrow(_searcher(k), schema)

        queries = dealt.where("q").select("uid", "id", "v", spread.alias("spread"))
        home = queries.select("uid", "id", "v", F.lit(None).cast("long").alias("floor"), "spread")
        part = shared(run(home.mapInArrow(_route(*table, True), _ROUTED)), spark)
        if total > 1:
            floors = part.groupBy("quid").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("got")).where((F.col("got") >= k) & (F.col("floor") > -_TOP)).select(F.col("quid").alias("uid"), "floor")
            asked = queries.join(floors, "uid", "left").select("uid", "id", "v", "floor", "spread")
            part = part.unionByName(run(asked.mapInArrow(_route(*table, False), _ROUTED)))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")  # at most k rows from each shard that was asked
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(key) if key != "vec_id" else "vec_id", "score")
