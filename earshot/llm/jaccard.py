"""N-gram Jaccard join: size-aware, heavy sets by inverted lists, light sets by fixed-size subsets.

Documents are sets of word shingles; two link when 100 * intersection >= percent * union. The result is
each document's connected component.

1. Reduction: a set with a partner shares percent of its shingles with it, so a set with fewer
   shingles that occur elsewhere has none. Shingles are counted by truncated hashes in packed blocks (a
   false match only keeps a set that later steps drop).
2. Equal sets become one class, so copies are never paired.
3. In the order of rising document frequency, two linked sets share a shingle among the first
   n - ceil(percent n) + 1 of each (a prefix), and k of them in a prefix that is k - 1 longer. Light sets, up
   to a size boundary, emit all pairs of the longer prefix as keys; heavy ones the single
   shingles of the shorter prefix, whose inverted lists are scanned. The boundary minimises the number of keys
   and list entries estimated from the sizes. Light sets near the boundary emit both.
4. Sets in a list are ordered by size and chained where the ratio of sizes allows a link; no pairs are
   made. Chains give coarse components, which contain the true ones.
5. Each set is compared with the two that follow it in most of its lists. The links found unite nearly all of a group of
   near copies, however large, and a coarse component that they unite whole needs no further look.
6. Sets of the others go through the lists once more, with the components known so far. A list with few pairs of
   different components that may link (four for each of its sets, so linear) has them compared; others are chained again.
7. What such chains leave together is resolved exactly in one task: a pivot is intersected with all sets left, linked sets are
   united, and by the triangle inequality of the Jaccard distance members of the pivot's component that are too near to
   the pivot to link to anything outside leave the search. Ends when all sets left are in one component. This
   task grows only with lists in which very many sets of different components meet.

Shingles are known by 64-bit hashes, words by polynomials modulo 2**61 - 1.

Defined cases: null texts and texts without words are empty sets, of size 0 and linked with nothing; texts of
fewer words than a shingle are one shingle; very long texts are sets like others (their shingles travel in blocks); equal rows
are told apart by their place; ids are integers, null ids come first; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import place, shared
from .graph import connected_components
from .lm import bucket_of
from .textbuf import Buf, chunks, mix, windows

_BROADCAST_ROWS = 200_000
_BLOCK_SCHEMA = "bucket int, base long, a binary, b binary"


def shingle_sets(buf: Buf, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of word k-grams of each text, in a row, and offsets."""
    s, e, doc = buf.words()
    h = buf.hashes(s, e, lower=True)
    w, at = windows(h, doc, k)
    d = doc[at]
    n = np.bincount(doc, minlength=buf.n)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        first = np.searchsorted(doc, few)
        x = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            more = j < n[few]
            x = np.where(more, x * np.uint64(0xD6E8FEB86659FD93) + h[np.minimum(first + j, len(h) - 1)], x)
        w = np.concatenate([w, mix(x ^ mix(n[few].astype(np.uint64)))])
        d = np.concatenate([d, few])
    order = np.lexsort((w, d))
    w, d = w[order], d[order]
    new = np.append(True, (w[1:] != w[:-1]) | (d[1:] != d[:-1])) if len(w) else np.zeros(0, bool)
    w, d = w[new], d[new]
    return w, np.searchsorted(d, np.arange(buf.n + 1))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["bucket", "base", "a", "b"])


def _emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 64):
        yield _batch(rows[lo : lo + 64])


def _cuts(of: np.ndarray, blocks: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(blocks + 1))
    return order, [(k, x, y) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]


def _all_shingles(k: int, blocks: int):
    """For each block of hashes: base (place of a unit's first text), numbers of texts, truncated hashes. Bucket -1: set sizes, and in b places of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold, sizes, places, rows, size = [], [], [], 0, 0

        def out():
            base = int(places[0][0])
            h = np.concatenate([x[0] for x in hold])
            doc = np.concatenate([x[1] for x in hold])
            order, cuts = _cuts(bucket_of(h, blocks), blocks)
            low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield from _emit([(j, base, doc[order[x:y]].tobytes(), low[order[x:y]].tobytes()) for j, x, y in cuts])
            yield _batch([(-1, base, np.concatenate(sizes).astype(np.uint32).tobytes(), np.concatenate(places).tobytes())])

        for batch in batches:
            uids = batch.column(0).to_numpy()
            for lo, hi, buf in chunks(batch.column(1)):
                w, off = shingle_sets(buf, k)
                if rows and (rows + buf.n > 60_000 or size + len(w) > 800_000):
                    yield from out()
                    hold, sizes, places, rows, size = [], [], [], 0, 0
                hold.append((w, (np.repeat(np.arange(buf.n), np.diff(off)) + rows).astype(np.uint16)))
                sizes.append(np.diff(off))
                places.append(uids[lo:hi])
                rows, size = rows + buf.n, size + len(w)
        if rows:
            yield from out()

    return run


def _base_bucket(base: int, blocks: int) -> int:
    return int(mix(np.array([base], np.uint64))[0] % np.uint64(blocks))


def _shared_counts(blocks: int):
    """For each text the number of its shingles in the block that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for batch in batches:
            for k, base, a, b in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if k < 0:
                    yield _batch([(-1 - _base_bucket(base, blocks), base, a, b)])
                else:
                    got.setdefault(k, []).append((base, np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint32)))
        for parts in got.values():
            h = np.concatenate([p[2] for p in parts])
            order = np.argsort(h)
            s = h[order]
            same = s[1:] == s[:-1]
            hit = np.zeros(len(h), bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            at = 0
            for base, doc, x in parts:
                u, c = np.unique(doc[hit[at : at + len(x)]], return_counts=True)
                at += len(x)
                if len(u):
                    yield _batch([(_base_bucket(base, blocks), base, u.tobytes(), c.astype(np.uint32).tobytes())])

    return run


def _reduce(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size of each text's set, and whether it may have partners."""
        size: dict[int, tuple] = {}
        counts: dict[int, list] = {}
        for batch in batches:
            for bucket, base, a, b in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if bucket >= 0:
                    counts.setdefault(base, []).append((np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint32)))
                else:
                    size[base] = np.frombuffer(a, np.uint32).astype(np.int64), np.frombuffer(b, np.int64)
        for base, (n, uid) in size.items():
            c = np.zeros(len(n), np.int64)
            for u, x in counts.get(base, []):
                c[u] += x
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(n), pa.array((n > 0) & (100 * c >= percent * n))], names=["_uid", "n", "alive"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf in chunks(batch.column(2)):
                w, off = shingle_sets(buf, k)
                blobs = [w[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in blobs], pa.binary()), pa.array(blobs, pa.binary())], names=["_uid", "_id", "digest", "s"])

    return run


_ENTRY = np.dtype([("h", "<u8"), ("u", "<i8"), ("k", "<u4")])
_CODE = np.dtype([("u", "<i8"), ("k", "<u4"), ("df", "<u4")])


def _entries(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold, size = [], 0

        def out():
            x = np.concatenate(hold)
            order, cuts = _cuts(bucket_of(x["h"], blocks), blocks)
            yield from _emit([(j, 0, x[order[a:b]].tobytes(), b"") for j, a, b in cuts])

        for batch in batches:
            for u, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(s, np.uint64)
                x = np.empty(len(h), _ENTRY)
                x["h"], x["u"], x["k"] = h, u, np.arange(len(h))
                hold.append(x)
                size += len(h)
                if size > 1_000_000:
                    yield from out()
                    hold, size = [], 0
        if size:
            yield from out()

    return run


def _frequencies(blocks: int):
    """Document frequencies of shingles in more than one set, sent back to their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for batch in batches:
            for k, a in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                got.setdefault(k, []).append(np.frombuffer(a, _ENTRY))
        for parts in got.values():
            x = np.concatenate(parts)
            _, back, c = np.unique(x["h"], return_inverse=True, return_counts=True)
            df = c[back]
            x, df = x[df > 1], df[df > 1]
            y = np.empty(len(x), _CODE)
            y["u"], y["k"], y["df"] = x["u"], x["k"], df
            order, cuts = _cuts((mix(y["u"].astype(np.uint64)) % np.uint64(blocks)).astype(np.int64), blocks)
            y = y[order]
            yield from _emit([(j, 1, y[a:b].tobytes(), b"") for j, a, b in cuts])

    return run


def prefix(n: int, percent: int, k: int) -> int:
    """Length of the prefix in which two linked sets share k shingles."""
    return min(n, n - -(-percent * n // 100) + k)


def boundary(sizes: dict[int, int], percent: int, scan: float = 3.0) -> int:
    """The size up to which sets are light, at least cost: a unit for each key, and scan list entries more for each single-shingle key.

    Light sets that may link to heavy ones pay for both. Tried are the sizes themselves, and those just large enough
    that a size pays once.
    """
    n = np.array(sorted(sizes), np.int64)
    if not len(n):
        return 0
    count = np.array([sizes[x] for x in n.tolist()], float)
    one, two = (np.array([prefix(x, percent, k) for x in n.tolist()], float) for k in (1, 2))
    light, heavy = (np.concatenate([[0], np.cumsum(count * c)]) for c in (two * (two - 1) / 2, one * (1 + scan)))
    tried = np.unique(np.concatenate([[0], n, 100 * n // percent + 1]))
    upto = np.searchsorted(n, tried, side="right")
    zone = np.minimum(np.searchsorted(n, percent * (tried + 1) / 100, side="left"), upto)
    cost = light[upto] + heavy[-1] - heavy[upto] + heavy[upto] - heavy[zone]
    return int(tried[cost.argmin()])


_KEY = np.dtype([("h", "<u8"), ("u", "<i8"), ("n", "<u4"), ("label", "<i8")])
_PAIRS_A_SET = 4


def _keys(blocks: int, percent: int, light: int):
    """Keys of the prefixes of each set. Rows: sets (base = id, a = shingles, b = label) and blocks of frequencies (b empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, tuple] = {}
        codes = []
        for batch in batches:
            for base, a, b in zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), strict=True):
                if b:
                    sets[base] = np.frombuffer(a, np.uint64), int.from_bytes(b, "little", signed=True)
                else:
                    codes.append(np.frombuffer(a, _CODE))
        y = np.concatenate(codes) if codes else np.zeros(0, _CODE)
        y = y[np.argsort(y["u"], kind="stable")]
        hold, size = [], 0

        def out():
            x = np.concatenate(hold)
            order, cuts = _cuts(bucket_of(x["h"], blocks), blocks)
            yield from _emit([(j, 0, x[order[a:b]].tobytes(), b"") for j, a, b in cuts])

        for u, (h, label) in sets.items():
            lo, hi = np.searchsorted(y["u"], [u, u + 1])
            df = np.ones(len(h), np.int64)
            df[y["k"][lo:hi]] = y["df"][lo:hi]
            n = len(h)
            order = np.lexsort((mix(h ^ np.uint64(0x51)), df))
            keys = []
            if n <= light:
                p = mix(h[order[: prefix(n, percent, 2)]])
                i, j = np.triu_indices(len(p), 1)
                keys.append(mix(p[i] + p[j]))
            if n > light or 100 * n >= percent * (light + 1):
                p = order[: prefix(n, percent, 1)]
                keys.append(mix(h[p[df[p] > 1]] ^ np.uint64(0xA5A5)))  # lists of one set hold no link
            for key in keys:
                x = np.empty(len(key), _KEY)
                x["h"], x["u"], x["n"], x["label"] = key, u, n, label
                hold.append(x)
                size += len(x)
            if size > 1_000_000:
                yield from out()
                hold, size = [], 0
        if size:
            yield from out()

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Entries of each block, by key and rising size."""
    got: dict[int, list] = {}
    for batch in batches:
        for k, a in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            got.setdefault(k, []).append(np.frombuffer(a, _KEY))
    while got:
        _, parts = got.popitem()
        x = np.concatenate(parts)
        x = x[np.lexsort((x["u"], x["n"], x["h"]))]
        new = np.append(True, (x["h"][1:] != x["h"][:-1]) | (x["u"][1:] != x["u"][:-1]))
        yield x[new]


def _neighbours(x: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of neighbours in a list whose sizes allow a link."""
    n = x["n"].astype(np.int64)
    at = np.flatnonzero((x["h"][1:] == x["h"][:-1]) & (100 * n[:-1] >= percent * n[1:]))
    return at, at + 1


def _chain(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges between neighbours by size in the list of each key, and in how many lists."""
        for x in _lists(batches):
            a, b = _neighbours(x, percent)
            e, c = np.unique(np.stack([x["u"][a], x["u"][b]], 1), axis=0, return_counts=True)
            if len(e):
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.array(c)], names=["a", "b", "c"])

    return run


def _cross(percent: int):
    """Pairs of different labels in lists that have few of them (few = true), neighbours of different labels in the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _lists(batches):
            first = np.flatnonzero(np.append(True, x["h"][1:] != x["h"][:-1]))
            pairs, chains = [], []
            for lo, hi in zip(first.tolist(), np.append(first[1:], len(x)).tolist(), strict=True):
                own, n = x[lo:hi], x["n"][lo:hi].astype(np.int64)
                if (own["label"] == own["label"][0]).all():
                    continue
                far = np.searchsorted(n, 100 * n // percent, side="right")  # sets that are not too large for each
                later = far - np.arange(len(own)) - 1
                _, same = np.unique(own["label"], return_inverse=True)
                # pairs of one label, among those in reach: by the rank of each set among its label's
                by = np.lexsort((np.arange(len(own)), same))
                code = same[by] * (len(own) + 1) + by
                equal = np.searchsorted(code, same * (len(own) + 1) + far) - np.searchsorted(code, same * (len(own) + 1) + np.arange(len(own))) - 1
                if (later - equal).sum() > _PAIRS_A_SET * len(own):
                    chains.append(own)
                    continue
                for k in np.flatnonzero(later > equal).tolist():
                    other = own["u"][k + 1 : far[k]][same[k + 1 : far[k]] != same[k]]
                    pairs.append(np.stack([np.full(len(other), own["u"][k]), other], 1))
            if chains:
                c = np.concatenate(chains)
                a, b = _neighbours(c, percent)
                m = c["label"][a] != c["label"][b]
                chain = np.unique(np.stack([c["label"][a[m]], c["label"][b[m]]], 1), axis=0)
                yield _edges(chain, False)
            if pairs:
                yield _edges(np.unique(np.concatenate(pairs), axis=0), True)

    return run


def _edges(e: np.ndarray, few: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.array(np.full(len(e), few))], names=["a", "b", "few"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of pairs of sets those that link."""
        for batch in batches:
            hit = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                hit.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(j).filter(pa.array(hit, pa.bool_())) for j in (0, 1)], names=["a", "b"])

    return run


def resolve(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the components of sets under links, exactly; sets of equal numbers in known are in one."""
    m = len(sets)
    label = np.arange(m) if known is None else np.unique(known, return_inverse=True)[1]
    if m < 2:
        return label
    n = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size, start = int(flat.max()) + 1, np.concatenate([[0], np.cumsum(n)])
    alive, own, off = np.arange(m), flat, start[:-1]
    mark = np.zeros(size, np.int32)
    packed = m
    while len(alive) > 1 and (label[alive] != label[alive[0]]).any():
        if len(alive) <= packed // 2:  # what has left is not looked at again
            own = np.concatenate([flat[start[x] : start[x + 1]] for x in alive])
            off = np.concatenate([[0], np.cumsum(n[alive])[:-1]])
            order, packed = alive.copy(), len(alive)
        elif packed == m:
            order = np.arange(m)
        p = alive[0]
        ids = flat[start[p] : start[p + 1]]
        mark[ids] = 1
        inter = np.add.reduceat(mark[own], off).astype(np.int64)
        mark[ids] = 0
        union = n[order] + n[p] - inter
        live = np.isin(order, alive, assume_unique=True)
        near = order[live & (100 * inter >= percent * union)]
        for lab in np.unique(label[near]):
            if lab != label[p]:
                label[label == lab] = label[p]
        d = np.full(m, np.inf)
        d[order] = 1 - inter / union
        inside = label[alive] == label[p]
        outer = d[alive[~inside]].min() if (~inside).any() else np.inf
        stay = ~inside | (d[alive] + (1 - percent / 100) >= outer - 1e-9)
        stay[0] = False  # its links are all known
        alive = alive[stay]
    return label


def _resolve(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by coarse component; the smallest id of each exact one."""
        now, ids, known, sets = None, [], [], []

        def out():
            label = resolve(sets, percent, np.array(known))
            u = np.array(ids)
            least = np.full(len(u), np.iinfo(np.int64).max)
            np.minimum.at(least, label, u)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(least[label])], names=["node", "part"])

        for batch in batches:
            for c, u, label, s in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if c != now:
                    if ids:
                        yield out()
                    now, ids, known, sets = c, [], [], []
                ids.append(u)
                known.append(label)
                sets.append(np.frombuffer(s, np.uint64))
        if ids:
            yield out()

    return run


def _components(own: DataFrame, percent: int, blocks: int) -> DataFrame:
    """node and part (the same for all sets of a component) of the distinct sets own (_uid, s) that may link to others."""
    spark = own.sparkSession

    def lists(sets: DataFrame) -> DataFrame:
        sizes = {int(r["n"]): r["c"] for r in sets.groupBy((F.length("s") / 8).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
        freq = sets.mapInArrow(_entries(blocks), _BLOCK_SCHEMA).repartition(blocks, "bucket").mapInArrow(_frequencies(blocks), _BLOCK_SCHEMA)
        keys = freq.union(sets.mapInArrow(_place(blocks), _BLOCK_SCHEMA)).repartition(blocks, "bucket").mapInArrow(_keys(blocks, percent, boundary(sizes, percent)), _BLOCK_SCHEMA)
        return keys.repartition(blocks, "bucket")

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = own.select(F.col("_uid").alias("a"), F.col("s").alias("s")), own.select(F.col("_uid").alias("b"), F.col("s").alias("t"))
        return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(_verify(percent), "a long, b long")

    def labelled(links: DataFrame) -> DataFrame:
        found = connected_components(links)
        return shared(own.select("_uid").join(found, own["_uid"] == found["node"], "left").select("_uid", F.coalesce("component", "_uid").alias("label")), spark)

    def between(edges: DataFrame, labels: DataFrame) -> DataFrame:
        one, two = labels.select(F.col("_uid").alias("a"), F.col("label").alias("la")), labels.select(F.col("_uid").alias("b"), F.col("label").alias("lb"))
        return edges.join(one, "a").join(two, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))

    edges = shared(lists(own.select("_uid", "s", F.lit(0).cast("long").alias("label"))).mapInArrow(_chain(percent), "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c")), spark)
    order = Window.partitionBy("a").orderBy(F.desc("c"), "b")  # a set has no more neighbours than keys
    links = shared(verified(edges.withColumn("r", F.row_number().over(order)).where("r <= 2")), spark)
    labels = labelled(links)
    coarse = connected_components(between(edges, labels)).select(F.col("node").alias("label"))
    mixed = own.join(labels, "_uid").join(coarse.distinct(), "label", "left_semi").select("_uid", "s", "label")
    cross = shared(lists(shared(mixed, spark)).mapInArrow(_cross(percent), "a long, b long, few boolean").distinct(), spark)
    more = verified(cross.where("few"))
    labels = labelled(links.union(more))
    rest = connected_components(between(cross.where(~F.col("few")), labels))  # a component is named by one of its sets
    left = own.join(labels, "_uid").join(rest, F.col("label") == F.col("node")).select("component", "_uid", "label", "s")
    exact = left.repartition(blocks, "component").sortWithinPartitions("component").mapInArrow(_resolve(percent), "node long, part long")
    return labels.join(exact, labels["_uid"] == exact["node"], "left").select(F.col("_uid").alias("node"), F.coalesce("part", "label").alias("part"))


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = 5, text: str = "text", key: str = "doc_id", uid: str | None = None) -> DataFrame:
    """_uid, key, n_shingles, component_id (smallest key reachable by links) and first (the row that stands for its component).

    uid: a column that tells the rows apart and stays the same (from common.place); without it the rows are placed here.
    """
    spark: SparkSession = docs.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    own_id = F.col(key).cast("long").alias("_id")
    docs = place(docs.select(own_id, F.col(text).alias("_text"))) if uid is None else docs.select(F.col(uid).alias("_uid"), own_id, F.col(text).alias("_text"))
    docs = docs.select("_uid", "_id", "_text")
    counted = docs.select("_uid", "_text").mapInArrow(_all_shingles(words, blocks), _BLOCK_SCHEMA).repartition(blocks, F.when(F.col("bucket") < 0, F.col("base") % 1009).otherwise(F.col("bucket"))).mapInArrow(_shared_counts(blocks), _BLOCK_SCHEMA)
    state = shared(counted.repartition(blocks, F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))).mapInArrow(_reduce(percent), "_uid long, n long, alive boolean"), spark)
    alive = state.where("alive").select("_uid")
    few = alive.count() <= _BROADCAST_ROWS  # beyond that both sides are shuffled
    sets = shared(docs.join(F.broadcast(alive) if few else alive, "_uid").select("_uid", "_id", "_text").mapInArrow(_sets(words), "_uid long, _id long, digest binary, s binary"), spark)
    classes = shared(sets.groupBy("digest").agg(least_of("_id", "_uid").alias("m")).select("digest", F.col("m.u").alias("rep"), F.col("m._id").alias("_id")), spark)
    reps = classes.select(F.col("rep").alias("_uid"))
    own = shared(sets.join(F.broadcast(reps) if few else reps, "_uid").select("_uid", "s"), spark)  # one for each class
    exact = _components(own, percent, blocks)
    of_class = shared(classes.join(exact, classes["rep"] == exact["node"], "left").select("digest", "rep", "_id", F.coalesce("part", "rep").alias("part")), spark)
    heads = of_class.groupBy("part").agg(least_of("_id", "rep").alias("m")).select("part", F.col("m._id").alias("component_id"), F.col("m.u").alias("head"))
    members = sets.select("_uid", "digest").join(of_class.join(heads, "part").select("digest", "component_id", "head"), "digest").select("_uid", "component_id", "head")
    all_ = state.select("_uid", F.col("n").alias("n_shingles")).join(members, "_uid", "left").join(docs.select("_uid", "_id"), "_uid")
    return all_.select("_uid", F.col("_id").alias(key), "n_shingles", F.when(F.col("head").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"), (F.col("head").isNull() | (F.col("head") == F.col("_uid"))).alias("first"))


def least_of(key: str, uid: str):
    return F.min(F.struct(F.coalesce(key, F.lit(-(1 << 63))).alias("o"), F.col(uid).alias("u"), F.col(key)))


def _place(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = (mix(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(blocks)).astype(np.int32)
            labels = [x.to_bytes(8, "little", signed=True) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(of), batch.column(0), batch.column(1), pa.array(labels, pa.binary())], names=["bucket", "base", "a", "b"])

    return run
