"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts anywhere else are removed.

The ordering of suffixes is built column by column over many strings at once: each round puts one more symbol in
front of every string, re-orders the suffixes that now start there (a stable sort of the order before by
the new symbols, which are that column of the Burrows-Wheeler transform) and updates the common prefixes of
neighbours (one more than the least of those passed over, or 0 at a change of symbol). After `length` rounds a
neighbour's common prefix of `length` or more says that the string which starts there repeats.

Whole documents need as many rounds as the longest has bytes, so the strings are the stretches in which a repeat is possible,
aligned so that equal strings stand in the same column:

1. Anchors: every window of `length` bytes picks the smallest of its hashed 32-byte strings (leftmost if equal). The
   choice depends on the window's bytes only, so equal windows have equal anchors at equal places. An anchor's windows
   are of two kinds by their reach to the left; those of a kind share a core of more than half
   of the window, around the anchor.
2. Cores that occur once rule their windows out (counted by truncated hashes: a false match only keeps one).
3. The stretches around the cores that are left meet by the hash of the core. Equal stretches become one; of
   groups with different ones the columns are built as above. Windows of one stretch overlap, so its repeated ones make
   one interval.
4. Intervals are merged by document and cut out.

A core with many different stretches (counted by 16-bit hashes in step 2, so exact copies don't count) would gather
them all in one task. Its windows are dealt into finer kinds, whose cores are longer and whose stretches are shorter: 16
kinds from `hot[0]` different hashes on (16,000 are about 19,000 stretches), and from `hot[1]` on (60,000: about 160,000) one for
each window, where equal cores are equal windows, so that no bytes are sent and no columns are needed. So a task
builds columns for about 160,000 short strings of a core at most, however common it is; finer kinds take more
shuffled bytes (16 strings of 411 bytes for one of 584), which is why they are kept for such cores.

What the named method has and this has not: columns decide only for groups of unequal stretches (equality of digests
decides the others), they are built in memory from the strings that a shuffle brought together, only marks
are kept, and there are no sequential files and no kept transform.

Defined cases: null and empty texts have 0 bytes and no span; texts shorter than `length` stay whole; very long texts are
handled whole, with memory for a few arrays of 8 bytes for each of their bytes; equal rows cover each other;
matches never cross rows, also not rows of an equal id; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import place, shared
from .lm import bucket_of
from .textbuf import Buf, chunks, mix

_GRAM = 32
_BROADCAST_BYTES, _BROADCAST_SPANS = 1 << 20, 16 << 20
_BLOCK_STRINGS = 20_000
_HOT = 16_000, 60_000
SCHEMA = "bucket int, base long, a binary, b binary"
_FOUND = np.dtype([("key", "<u4"), ("doc", "<u2"), ("p", "<u4"), ("around", "<u2")])
_BACK = np.dtype([("doc", "<u2"), ("p", "<u4"), ("level", "u1")])
_MARK = np.dtype([("p", "<u4"), ("level", "u1")])
_MEMBER = np.dtype([("key", "<u8"), ("digest", "V16"), ("u", "<i8"), ("p", "<u4")])
_STRING = np.dtype([("key", "<u8"), ("digest", "V16"), ("lo", "<u2"), ("hi", "<u2"), ("kind", "u1"), ("c0", "<u2"), ("c1", "<u2")])
_SPAN = np.dtype([("u", "<i8"), ("a", "<i8"), ("b", "<i8")])
_SYMBOL = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["bucket", "base", "a", "b"])


def _deal(x: np.ndarray, of: np.ndarray, base: int, blocks: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(blocks + 1))
    rows = [(k, base, x[order[a:b]].tobytes(), b"") for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    for lo in range(0, len(rows), 64):
        yield _batch(rows[lo : lo + 64])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the _GRAM bytes from each place on; they choose anchors, so equality isn't decided by them."""
    h, m = _SYMBOL[data], 1
    while m < _GRAM:
        h = h[:-m] * np.uint64(pow(0x9E3779B97F4A7C15, m, 2**64)) + h[m:]
        m *= 2
    return mix(h)


class Shape:
    """Window length, and the geometry of anchors, cores and stretches that follows."""

    def __init__(self, length: int):
        if length < 2 * _GRAM:
            raise ValueError(f"length must be {2 * _GRAM} or more")
        self.length, self.room = length, length - _GRAM  # room: largest distance of an anchor from its window's start
        self.half = self.room // 2
        # windows of kind 0 start half or more before the anchor, those of kind 1 half or less: first start, and number of the last
        self.first, self.last = (-self.room, -self.half), (self.room - self.half, self.half)
        self.parts = [[[(c[0], c[-1]) for c in np.array_split(np.arange(last + 1), min(n, last + 1))] for last in self.last] for n in (1, 16, length)]

    def core(self, kind: int, c0: int, c1: int) -> tuple[int, int]:
        """First byte and end, from the anchor, of what the kind's windows of numbers c0 to c1 share."""
        return self.first[kind] + c1, self.first[kind] + c0 + self.length

    def stretch(self, kind: int, c0: int, c1: int) -> tuple[int, int]:
        return self.first[kind] + c0, self.first[kind] + c1 + self.length


def anchors(buf: Buf, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, kind and text number of all (anchor, kind) that some window of the chunk has."""
    none = np.zeros(0, np.int64)
    n, L = len(buf.data), shape.length
    if n < L:
        return none, none, none
    v = (gram_hashes(buf.data) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - _GRAM + 1, dtype=np.uint64)
    w, size = shape.room + 1, 1
    m = v
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if w > size:
        m = np.minimum(m[: n - L + 1], m[w - size : w - size + n - L + 1])
    m = m[: n - L + 1]
    end = np.zeros(n + 1, np.int8)  # windows that cross into the next text don't count
    start = buf.off[:-1][buf.off[1:] - buf.off[:-1] >= L]
    stop = buf.off[1:][buf.off[1:] - buf.off[:-1] >= L] - L + 1
    np.add.at(end, start, 1)
    np.add.at(end, stop, -1)
    s = np.flatnonzero(np.cumsum(end[: n - L + 1]) > 0)
    if not len(s):
        return none, none, none
    p = (m[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)))
    last = np.append(first[1:], len(p)) - 1
    a, lo, hi = p[first], s[first], s[last]
    zero = lo <= a - shape.half
    one = hi >= a - shape.half
    pos = np.concatenate([a[zero], a[one]])
    kind = np.concatenate([np.zeros(zero.sum(), np.int64), np.ones(one.sum(), np.int64)])
    return pos, kind, buf.doc_of(pos)


def _salt(kind: int, c0: int, c1: int) -> np.uint64:
    return np.uint64(((kind + 1) << 32 | int(c0) << 16 | int(c1)) * 0x9E3779B97F4A7C15 % 2**64)


def _scan(shape: Shape, blocks: int):
    """Cores by block, and the places of a unit's texts (b is not empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold, places, rows, size = [], [], 0, 0

        def out():
            key, uid = np.concatenate([x[0] for x in hold]), np.concatenate(places)
            base = int(uid[0])
            yield _batch([(_of_base(base, blocks), base, uid.tobytes(), b"u")])
            yield from _deal(np.concatenate([x[1] for x in hold]), bucket_of(key, blocks), base, blocks)

        for batch in batches:
            uids = batch.column(0).to_numpy()
            for lo, hi, buf in chunks(batch.column(1)):
                if rows and (rows + buf.n > 60_000 or size > 1_000_000):
                    yield from out()
                    hold, places, rows, size = [], [], 0, 0
                pos, kind, doc = anchors(buf, shape)
                key, around = np.zeros(len(pos), np.uint64), np.zeros(len(pos), np.uint64)
                for k, last in enumerate(shape.last):
                    m = np.flatnonzero(kind == k)
                    if not len(m):
                        continue
                    (a, b), (c, d) = shape.core(k, 0, last), shape.stretch(k, 0, last)
                    key[m] = mix(buf.prefix().raw(pos[m] + a, pos[m] + b) ^ _salt(k, 0, last))
                    left, right = np.maximum(pos[m] + c, buf.off[doc[m]]), np.minimum(pos[m] + d, buf.off[doc[m] + 1])
                    around[m] = mix(buf.prefix().raw(left, right) ^ mix((left - pos[m] - c).astype(np.uint64)))
                x = np.empty(len(pos), _FOUND)
                x["key"], x["around"] = key & np.uint64(0xFFFFFFFF), around & np.uint64(0xFFFF)
                x["doc"], x["p"] = doc + rows, (pos - buf.off[doc]) * 2 + kind
                hold.append((key, x))
                places.append(uids[lo:hi])
                rows, size = rows + buf.n, size + len(pos)
        if rows:
            yield from out()

    return run


def _of_base(base: int, blocks: int) -> int:
    return int(mix(np.array([base], np.uint64))[0] % np.uint64(blocks))


def _repeated(blocks: int, hot: tuple[int, int]):
    """Sends back the cores that occur more than once, with the level to which their windows are to be dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for batch in batches:
            for k, base, a, b in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if b:
                    yield _batch([(k, base, a, b)])
                else:
                    got.setdefault(k, []).append((base, np.frombuffer(a, _FOUND)))
        while got:
            _, parts = got.popitem()
            both = np.concatenate([p[1]["key"].astype(np.uint64) << np.uint64(16) | p[1]["around"] for p in parts])
            order = np.argsort(both)
            both = both[order]
            key = both >> np.uint64(16)
            new = np.append(True, key[1:] != key[:-1])
            group, at = np.cumsum(new) - 1, np.flatnonzero(new)
            many = np.diff(np.append(at, len(key)))[group] > 1
            different = np.add.reduceat(np.append(True, both[1:] != both[:-1]).astype(np.int64), at)[group]
            level = np.empty(len(key), np.uint8)
            level[order] = np.where(many, (different > hot[0]).astype(np.uint8) + (different > hot[1]), 255)
            to = 0
            for base, x in parts:
                own, to = level[to : to + len(x)], to + len(x)
                hit = own < 255
                if hit.any():
                    y = np.empty(hit.sum(), _BACK)
                    y["doc"], y["p"], y["level"] = x["doc"][hit], x["p"][hit], own[hit]
                    yield _batch([(_of_base(base, blocks), base, y.tobytes(), b"")])

    return run


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got: dict[int, list] = {}
    places: dict[int, np.ndarray] = {}
    for batch in batches:
        for base, a, b in zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), strict=True):
            if b:
                places[base] = np.frombuffer(a, np.int64)
            else:
                got.setdefault(base, []).append(np.frombuffer(a, _BACK))
    for base, parts in got.items():
        x = np.concatenate(parts)
        x = x[np.argsort(x["doc"], kind="stable")]
        first = np.flatnonzero(np.append(True, x["doc"][1:] != x["doc"][:-1]))
        mark = np.empty(len(x), _MARK)
        mark["p"], mark["level"] = x["p"], x["level"]
        blobs = [mark[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(x)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(places[base][x["doc"][first]]), pa.array(blobs, pa.binary())], names=["_uid", "marks"])


def _stretches(shape: Shape, blocks: int):
    """Members (base 0) and strings (base 1, with their bytes in b) of cores, by block of the core's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[np.ndarray] = []
        strings: list[tuple] = []
        sent: set[bytes] = set()
        count = bytes_ = 0

        def out():
            x = np.concatenate(members)
            yield from _deal(x, bucket_of(x["key"], blocks), 0, blocks)
            if strings:
                head = np.empty(len(strings), _STRING)
                for j, name in ((0, "key"), (2, "lo"), (3, "hi"), (4, "kind"), (5, "c0"), (6, "c1")):
                    head[name] = [s[j] for s in strings]
                head["digest"] = np.frombuffer(b"".join(s[1] for s in strings), "V16")
                of = bucket_of(head["key"], blocks)
                order = np.argsort(of, kind="stable")
                cut = np.searchsorted(of[order], np.arange(blocks + 1))
                for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if b > a:
                        yield _batch([(k, 1, head[order[a:b]].tobytes(), b"".join(strings[j][7] for j in order[a:b]))])

        for batch in batches:
            uids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, buf in chunks(batch.column(2)):
                prefix, raw = buf.prefix(), buf.data.tobytes()
                for n in range(buf.n):
                    a, b = int(buf.off[n]), int(buf.off[n + 1])
                    own = []  # mark, place of the anchor, kind, first and last window
                    for mark, level in np.frombuffer(marks[lo + n], _MARK).tolist():
                        kind, pos = mark & 1, (mark >> 1) + a
                        for c0, c1 in shape.parts[level][kind]:
                            left, right = shape.core(kind, c0, c1)
                            if pos + left >= a and pos + right <= b:
                                own.append((mark, pos, kind, int(c0), int(c1), pos + left, pos + right, _salt(kind, c0, c1)))
                    if not own:
                        continue
                    left, right, salt = (np.array([x[j] for x in own], t) for j, t in ((5, np.int64), (6, np.int64), (7, np.uint64)))
                    key = mix(prefix.raw(left, right) ^ salt)
                    x = np.empty(len(own), _MEMBER)
                    x["key"], x["u"], x["p"] = key, uids[lo + n], [y[0] for y in own]
                    digests = []
                    for (_, p, k, c0, c1, *_), q in zip(own, key.tolist(), strict=True):
                        c, d = shape.stretch(k, c0, c1)
                        left, right = max(a, p + c), min(b, p + d)
                        cut = raw[left:right]
                        first, end = left - p - c, right - p - c
                        digest = hashlib.blake2b(b"%d %d %d %d " % (first, k, c0, c1) + cut, digest_size=16).digest()
                        digests.append(digest)
                        if digest not in sent:
                            if len(sent) > 100_000:
                                sent.clear()
                            sent.add(digest)
                            body = cut if c1 > c0 else b""  # a window by itself needs no columns
                            strings.append((q, digest, first, end, k, c0, c1, body))
                            bytes_ += len(body)
                    x["digest"] = np.frombuffer(b"".join(digests), "V16")
                    members.append(x)
                    count += len(x)
                    if bytes_ > 24 << 20 or count > 300_000:
                        yield from out()
                        members, strings, count, bytes_ = [], [], 0, 0
        if count:
            yield from out()

    return run


def column_repeats(symbols: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Marks (string, column) where the `length` symbols from that column on also start another string of the group at that column.

    symbols: a row for each string, 0 where it has none; group: sorted numbers. Builds the columns from the last to the first.
    """
    n, width = symbols.shape
    columns = np.ascontiguousarray(symbols.T)
    out = np.zeros((width - length + 1, n), bool)
    head = np.append(True, group[1:] != group[:-1])
    order = np.arange(n)  # suffixes of the column, by group and then in sorted order
    lcp = np.where(head, -width, 0)  # with the neighbour before
    for j in range(width - 1, -1, -1):
        sym = columns[j][order]
        change = np.flatnonzero((sym[1:] != sym[:-1]) & ~head[1:])
        lcp += 1
        if len(change):
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[change + 1]] = True
            at = np.flatnonzero(mixed[group])
            old, g, s = lcp[at], group[at], sym[at]
            by = np.lexsort((s, g))  # stable
            s = s[by]
            same = np.flatnonzero((s[1:] == s[:-1]) & (g[1:] == g[:-1])) + 1
            new = np.zeros(len(at), lcp.dtype)
            if len(same):
                ranges = np.stack([by[same - 1] + 1, by[same] + 1], 1).ravel()
                new[same] = np.minimum.reduceat(np.append(old, width), ranges)[::2]
            order[at], lcp[at], sym[at] = order[at][by], new, s
        lcp[sym == 0] = 0
        lcp[head] = -width
        if j <= width - length:
            far = lcp >= length
            far[:-1] |= far[1:]
            out[j][order[far]] = True
    return out.T


def _intervals(shape: Shape, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for k, base, a, b in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                pair = got.setdefault(k, ([], []))
                if base == 0:
                    pair[0].append(np.frombuffer(a, _MEMBER))
                else:
                    pair[1].append((np.frombuffer(a, _STRING), b))
        while got:
            _, (members, strings) = got.popitem()
            x = np.concatenate(members)
            head = np.concatenate([s[0] for s in strings])
            data = np.frombuffer(b"".join(s[1] for s in strings), np.uint8)
            size = np.where(head["c1"] > head["c0"], head["hi"].astype(np.int64) - head["lo"], 0)
            off = np.concatenate([[0], np.cumsum(size)])
            # one of each (core, stretch)
            name = np.frombuffer(head["digest"].tobytes(), "<u8").reshape(-1, 2)
            order = np.lexsort((name[:, 0], name[:, 1], head["key"]))
            h, m = head["key"][order], name[order]
            first = np.append(True, (h[1:] != h[:-1]) | (m[1:] != m[:-1]).any(1))
            row = order[first]
            key, name = head["key"][row], name[row]
            # members of each
            mine = np.frombuffer(x["digest"].tobytes(), "<u8").reshape(-1, 2)
            both = np.concatenate([np.column_stack([key, name]), np.column_stack([x["key"], mine])])
            _, back = np.unique(both, axis=0, return_inverse=True)
            back = back.ravel()
            place = np.full(len(both), -1)
            place[back[: len(row)]] = np.arange(len(row))
            of = place[back[len(row) :]]
            count = np.bincount(of, minlength=len(row))
            lo, hi = head["lo"][row].astype(np.int64), head["hi"][row].astype(np.int64)
            kind, c0, c1 = (head[name][row].astype(np.int64) for name in ("kind", "c0", "c1"))
            last = c1 - c0  # windows of the stretch start in columns 0 to last
            a = np.where(count > 1, lo, 1 << 30)
            b = np.where(count > 1, np.minimum(last, hi - shape.length), -1)
            group = np.cumsum(np.append(False, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            crowd = np.flatnonzero((np.bincount(group)[group] > 1) & (last > 0))
            at = 0
            while at < len(crowd):  # blocks of whole groups
                to = min(at + _BLOCK_STRINGS, len(crowd))
                while to < len(crowd) and group[crowd[to]] == group[crowd[to - 1]]:
                    to += 1
                part = crowd[at:to]
                symbols = np.zeros((len(part), int(last[part].max()) + shape.length), np.uint16)
                for n, r in enumerate(part.tolist()):
                    o = off[row[r]]
                    symbols[n, lo[r] : hi[r]] = data[o : o + hi[r] - lo[r]]
                    symbols[n, lo[r] : hi[r]] += 1
                g = group[part]
                marks = column_repeats(symbols, np.cumsum(np.append(False, g[1:] != g[:-1])), shape.length)
                marks &= np.arange(marks.shape[1])[None, :] <= last[part][:, None]
                hit = marks.any(1)
                w = part[hit]
                a[w] = np.minimum(a[w], marks[hit].argmax(1))
                b[w] = np.maximum(b[w], marks.shape[1] - 1 - marks[hit][:, ::-1].argmax(1))
                at = to
            ok = (b >= a)[of]
            x, of = x[ok], of[ok]
            if len(x):
                y = np.empty(len(x), _SPAN)
                start = (x["p"] >> 1).astype(np.int64) + np.array(shape.first)[kind[of]] + c0[of]
                y["u"], y["a"], y["b"] = x["u"], start + a[of], start + b[of] + shape.length
                yield from _deal(y, (mix(y["u"].astype(np.uint64)) % np.uint64(blocks)).astype(np.int64), 0, blocks)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of removed bytes of each text."""
    got: dict[int, list] = {}
    for batch in batches:
        for k, a in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            got.setdefault(k, []).append(np.frombuffer(a, _SPAN))
    for parts in got.values():
        x = np.concatenate(parts)
        x = x[np.lexsort((x["a"], x["u"]))]
        text = np.cumsum(np.append(False, x["u"][1:] != x["u"][:-1]))
        far = int(x["b"].max()) + 2
        reach = np.maximum.accumulate(x["b"] + text * far) - text * far
        new = np.append(True, (text[1:] != text[:-1]) | (x["a"][1:] > reach[:-1]))
        at = np.flatnonzero(new)
        end = reach[np.append(at[1:], len(x)) - 1]
        u, a = x["u"][at], x["a"][at]
        first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        cut = pa.array(np.append(first, len(u)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(u[first]), pa.ListArray.from_arrays(cut, pa.array(a)), pa.ListArray.from_arrays(cut, pa.array(end))], names=["_uid", "starts", "ends"])


def repeated_spans(placed: DataFrame, length: int = 400, text: str = "text", hot: tuple[int, int] = _HOT) -> DataFrame:
    """_uid, starts and ends (bytes) of the maximal runs covered by repeated strings; rows without any have none. placed: from common.place."""
    spark: SparkSession = placed.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    shape = Shape(length)
    rows = placed.select("_uid", text)
    marks = rows.mapInArrow(_scan(shape, blocks), SCHEMA).repartition(blocks, "bucket").mapInArrow(_repeated(blocks, hot), SCHEMA).repartition(blocks, "bucket").mapInArrow(_by_text, "_uid long, marks binary")
    marks = shared(marks, spark)
    small = (marks.agg(F.sum(F.length("marks") + 16)).first()[0] or 0) <= _BROADCAST_BYTES  # beyond that both sides are shuffled
    texts = rows.join(F.broadcast(marks) if small else marks, "_uid").select("_uid", "marks", text)
    strings = texts.mapInArrow(_stretches(shape, blocks), SCHEMA).repartition(blocks, "bucket")
    spans = strings.mapInArrow(_intervals(shape, blocks), SCHEMA).repartition(blocks, "bucket")
    return shared(spans.mapInArrow(_merge, "_uid long, starts array<long>, ends array<long>"), spark)


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", key: str = "doc_id", digest: bool = False, hot: tuple[int, int] = _HOT, passage: int | None = None) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept (the bytes left) of every row of docs; with digest, kept_sha256 instead of kept.

    With passage, also n_passage: the bytes covered by repeated strings of that (shorter) length, which are told but not removed.
    """
    spark = docs.sparkSession
    placed = place(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    spans = repeated_spans(placed, length, "_text", hot)
    small = (spans.agg(F.sum(F.size("starts") * 16 + 32)).first()[0] or 0) <= _BROADCAST_SPANS
    joined = placed.join(F.broadcast(spans) if small else spans, "_uid", "left").select("_uid", "_key", "_text", "starts", "ends")
    if passage:
        covered = repeated_spans(placed, passage, "_text", hot).select("_uid", F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y).alias("n_passage"))
        joined = joined.join(F.broadcast(covered) if small else covered, "_uid", "left").withColumn("n_passage", F.coalesce("n_passage", F.lit(0).cast("long")))
    joined = joined.drop("_uid")
    more = ["n_passage"] * bool(passage)
    kind, last = dict(docs.select(key).dtypes)[key], ("kept_sha256 string" if digest else "kept binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi, buf in chunks(batch.column(1)):
                raw, removed, kept = buf.data.tobytes(), [], []
                for n in range(buf.n):
                    t = raw[buf.off[n] : buf.off[n + 1]]
                    if a := starts[lo + n]:
                        b = ends[lo + n]
                        t = b"".join(t[x:y] for x, y in zip([0, *b], [*a, len(t)], strict=True))
                    removed.append(int(buf.off[n + 1] - buf.off[n]) - len(t))
                    kept.append(hashlib.sha256(t).hexdigest() if digest else t)
                n_spans = [len(x or ()) for x in starts[lo:hi]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(buf.off)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary()), *(batch.column(4).slice(lo, hi - lo) for _ in more)], names=[key, "n_bytes", "n_removed", "n_spans", last.split()[0], *more])

    return joined.mapInArrow(run, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, {last}" + "".join(f", {c} long" for c in more))
