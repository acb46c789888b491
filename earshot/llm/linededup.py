"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line (in the order of document id, place of the row, line number; over all
documents) is within the edit bound: equal, or at most `bound` inserted, deleted or replaced characters away if both
have at least `min_chars` characters. The earliest stays. Blank lines always stay and match nothing.

For the usual bound of one character:

1. Equal lines: hashes of lines, reduced to the earliest of each within each task, then over all.
2. A filter that loses nothing: two lines at distance 1 agree on the first or the last half (halves taken
   at the middle of the longer one), so hashed halves that no two distinct lines share rule a line out.
3. Lines that are left emit all variants with one character deleted (in the half that may differ) as hashed
   keys; those that may be the shorter line also their own hash. Equal variants of the same place are
   replacements, a variant equal to a whole line is an insertion. In each group of keys every line
   is set against the earliest only, so no pairs of a group are made.
4. Each (line, earlier line) found so is verified by its edit distance, and the later line is dropped.

For a larger bound k the same is done with all variants of up to k operations, each of which deletes a character or
marks its place as replaced. Lines x and y that meet in a variant with s marks, after dx and dy deletions, are within
s + dx + dy; so each line is set against the earliest line of the group whose deletions leave that sum within k, again
without pairs. Lines of k + 1 pieces that share no piece with another, at a shift that k edits allow, are ruled out
before. A line of n characters that is left has about (2 n)^k / k! variants, sent as rows, which is why the
bound is meant to stay small.

Keys travel in packed blocks, so a shuffled row holds many keys. Lines are known by polynomials modulo 2**61 - 1.
A block's keys are sorted in one task; blocks follow spark.sql.shuffle.partitions, and a hot line, half or variant has one key for each task that met it.

Defined cases: null texts stay null, empty texts stay empty; very long texts and lines are handled whole (a line of n
characters emits up to 2 n variants at a bound of 1, if a half of it occurs in another line; beyond that they are made in parts of a bounded size); a bound of 0 takes out equal lines only; equal rows are told apart by their place, so the
later loses its lines; a null id sorts first; ids are integers; an empty table gives an empty result; further columns stay as
they are, and counts whose names are taken get an underscore in front.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations, islice, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from .common import place, shared
from .lm import bucket_of
from .textbuf import Buf, chunks, mix, reduced

_SAME_FIRST, _SAME_LAST, _LONG_FIRST, _LONG_LAST, _SHORT = 1, 2, 4, 8, 16
_LOWEST = -(1 << 63)
#: hash, document id, place of the row, line number
LINE = np.dtype([("h", "<u8"), ("d", "<i8"), ("u", "<i8"), ("n", "<i4")])
SCHEMA = "bucket int, kind int, a binary, b binary"
_DROP, _LINES, _HALVES, _CODES = 0, 1, 2, 3
_BROADCAST_ROWS = 50_000
_PART = 50_000
LISTED = "_uid long, d long, n int, h long, code int"


class _Symbols:
    """Code points of a chunk, with hashes of the bytes of any stretch of them."""

    def __init__(self, buf: Buf):
        lead = (buf.data & 0xC0) != 0x80
        self.at = np.concatenate([[0], np.cumsum(lead)])  # code point at a byte
        self.byte = np.append(np.flatnonzero(lead), len(buf.data))  # first byte of a code point
        self.prefix = buf.prefix()

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.prefix.raw(self.byte[a], self.byte[b])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.raw(a, b))

    def without(self, a: int, cut: np.ndarray, b: int) -> np.ndarray:
        """Of [a, b) less the code point at each of cut."""
        first, at, after, end = self.byte[a], self.byte[cut], self.byte[cut + 1], self.byte[b]
        left = self.prefix.sum(np.full(len(cut), first), at)
        right = self.prefix.moved(self.prefix.sum(after, np.full(len(cut), end)), after - at)
        return self.prefix.moved(reduced(left + right), np.full(len(cut), first))


def real_lines(buf: Buf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes), text numbers and line numbers of the lines that aren't blank."""
    s, e, doc = buf.lines()
    first = np.searchsorted(doc, np.arange(buf.n))
    number = np.arange(len(s)) - first[doc]
    ws, _, _ = buf.words()
    k = np.searchsorted(ws, s)
    has = np.append(ws, len(buf.data) + 1)[k] < e
    return s[has], e[has], doc[has], number[has]


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["bucket", "kind", "a", "b"])


def _deal(key: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray | None, blocks: int) -> list[tuple]:
    """Blocks by key."""
    of = bucket_of(key, blocks)
    order = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(blocks + 1))
    return [(k, kind, a[order[x:y]].tobytes(), b"" if b is None else b[order[x:y]].tobytes()) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]


def _earliest(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest line of each hash, and the others."""
    lines = lines[np.lexsort((lines["n"], lines["u"], lines["d"], lines["h"]))]
    first = np.append(True, lines["h"][1:] != lines["h"][:-1]) if len(lines) else np.zeros(0, bool)
    return lines[first], lines[~first]


def _uid_key(u: np.ndarray) -> np.ndarray:
    return mix(u.astype(np.uint64))


def _scan(blocks: int, min_chars: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, halves, size = [], [], 0

        def out():
            first, rest = _earliest(np.concatenate(found))
            rows = _deal(first["h"], _LINES, first, None, blocks)
            if len(rest):
                rows += _deal(_uid_key(rest["u"]), _DROP, np.stack([rest["u"], rest["n"].astype(np.int64)], 1), None, blocks)
            if halves:
                x = np.unique(np.concatenate(halves), axis=0)
                rows += _deal(x[:, 0], _HALVES, x, None, blocks)
            for lo in range(0, len(rows), 64):
                yield _pack(rows[lo : lo + 64])

        for batch in batches:
            uids = batch.column(0).to_numpy()
            ids = batch.column(1).cast(pa.int64()).fill_null(_LOWEST).to_numpy()
            for lo, hi, buf in chunks(batch.column(2)):
                s, e, doc, number = real_lines(buf)
                if not len(s):
                    continue
                sym = _Symbols(buf)
                a, b = sym.at[s], sym.at[e]
                x = np.zeros(len(s), LINE)
                x["h"], x["d"], x["u"], x["n"] = sym.hash(a, b), ids[lo:hi][doc], uids[lo:hi][doc], number
                found.append(x)
                n = b - a
                k = np.flatnonzero(n >= min_chars)
                a, b, n, h = a[k], b[k], n[k], x["h"][k]
                for longer in (0, 1) if len(k) else ():  # as a line of the greater length, or one shorter than it
                    m = n + longer
                    half = m // 2
                    # the parity of a salt says which half it is, and the lowest bit of the value which length
                    salt = m.astype(np.uint64) * np.uint64(2)
                    for part, (c, d) in enumerate(((a, a + half), (b - (m - half), b))):
                        key = mix(sym.raw(c, d) ^ mix(salt + np.uint64(part)))
                        key = key & ~np.uint64(1) | np.uint64(part)
                        halves.append(np.stack([key, h & ~np.uint64(1) | np.uint64(longer)], 1))
                size += len(s)
                if size > 400_000:
                    yield from out()
                    found, halves, size = [], [], 0
        if size:
            yield from out()

    return run


def _settle(blocks: int):
    """Earliest lines over all tasks, dropped lines, and codes of the lines that halves don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, list] = {}
        halves: dict[int, list] = {}
        for batch in batches:
            for k, kind, a in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                if kind == _DROP:
                    yield _pack([(k, kind, a, b"")])
                elif kind == _LINES:
                    lines.setdefault(k, []).append(np.frombuffer(a, LINE))
                else:
                    halves.setdefault(k, []).append(np.frombuffer(a, np.uint64).reshape(-1, 2))
        while lines:
            k, parts = lines.popitem()
            first, rest = _earliest(np.concatenate(parts))
            rows = [(k, _LINES, first.tobytes(), b"")]
            if len(rest):
                rows += _deal(_uid_key(rest["u"]), _DROP, np.stack([rest["u"], rest["n"].astype(np.int64)], 1), None, blocks)
            yield _pack(rows)
        while halves:
            _, parts = halves.popitem()
            x = np.unique(np.concatenate(parts), axis=0)
            key, value = x[:, 0], x[:, 1]
            part, shorter, h = key & np.uint64(1), value & np.uint64(1), value & ~np.uint64(1)
            group = np.cumsum(np.append(False, key[1:] != key[:-1]))
            n = group[-1] + 1 if len(group) else 0
            of_length = np.bincount(group[shorter == 0], minlength=n)
            of_shorter = np.bincount(group[shorter == 1], minlength=n)
            same = (shorter == 0) & (of_length[group] > 1)
            long = (shorter == 0) & (of_shorter[group] > 0)
            short = (shorter == 1) & (of_length[group] > 0)
            code = np.where(part == 0, same * _SAME_FIRST + long * _LONG_FIRST, same * _SAME_LAST + long * _LONG_LAST) + short * _SHORT
            hit = code > 0
            if hit.any():
                yield _pack(_deal(h[hit], _CODES, np.stack([h[hit], code[hit].astype(np.uint64)], 1), None, blocks))

    return run


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins codes to the earliest lines, block by block."""
    lines: dict[int, list] = {}
    codes: dict[int, list] = {}
    for batch in batches:
        for k, kind, a in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
            if kind == _LINES:
                lines.setdefault(k, []).append(np.frombuffer(a, LINE))
            else:
                codes.setdefault(k, []).append(np.frombuffer(a, np.uint64).reshape(-1, 2))
    for k, parts in codes.items():
        x = np.concatenate(parts)
        x = x[np.argsort(x[:, 0], kind="stable")]
        first = np.flatnonzero(np.append(True, x[1:, 0] != x[:-1, 0]))
        h, code = x[first, 0], np.bitwise_or.reduceat(x[:, 1], first)
        # the last bit of a line's hash was lent to the code, so equal stems are looked up together
        own = np.concatenate(lines.get(k, [np.zeros(0, LINE)]))
        own = own[np.argsort(own["h"])]
        at = np.searchsorted(h, own["h"] & ~np.uint64(1))
        at = np.minimum(at, len(h) - 1)
        m = h[at] == own["h"] & ~np.uint64(1)
        own, code = own[m], code[at[m]]
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own["u"]), pa.array(own["d"]), pa.array(own["n"]), pa.array(own["h"].astype(np.int64)), pa.array(code.astype(np.int32))], names=["_uid", "d", "n", "h", "code"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the listed lines."""
    for batch in batches:
        uid, listed, texts = (batch.column(j).to_pylist() for j in range(3))
        rows = [(u, x["d"], x["n"], x["h"], x["code"], lines[x["n"]]) for u, xs, t in zip(uid, listed, texts, strict=True) for lines in [t.split("\n")] for x in xs]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["_uid", "d", "n", "h", "code", "line"])


def _variants(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys (key, is a whole line) with the lines that they come from."""
        for batch in batches:
            x = np.zeros(len(batch), LINE)
            for name, j in (("u", 0), ("d", 1), ("n", 2)):
                x[name] = batch.column(j).to_numpy()
            x["h"] = batch.column(3).to_numpy().astype(np.uint64)
            codes = batch.column(4).to_numpy()
            for lo, hi, buf in chunks(batch.column(5), 1 << 18):
                sym = _Symbols(buf)
                keys, of, whole = [], [], []
                for k in range(buf.n):
                    a, b = sym.at[buf.off[k]], sym.at[buf.off[k + 1]]
                    n, code = int(b - a), int(codes[lo + k])
                    half = n // 2
                    if code & _SHORT:
                        keys.append(mix(sym.raw(np.array([a]), np.array([b])) + np.uint64(5)))
                        of.append([k])
                        whole.append([True])
                    for first, last, (i, j) in ((_SAME_FIRST, _LONG_FIRST, (half, n)), (_SAME_LAST, _LONG_LAST, (0, half))):
                        if code & (first | last) and j > i:
                            cut = np.arange(a + i, a + j)
                            v = sym.without(a, cut, b)
                            if code & first:  # replacements: the place counts
                                keys.append(mix(v ^ mix((cut - a).astype(np.uint64) + np.uint64(n << 32))))
                            if code & last:
                                keys.append(mix(v + np.uint64(5)))
                            for _ in range(bool(code & first) + bool(code & last)):
                                of.append(np.full(len(cut), k))
                                whole.append(np.zeros(len(cut), bool))
                if keys:
                    key = np.concatenate(keys)
                    row = x[lo + np.concatenate(of)]
                    pair = np.stack([key, np.concatenate(whole).astype(np.uint64)], 1)
                    rows = _deal(key, 0, pair, row, blocks)
                    for p in range(0, len(rows), 64):
                        yield _pack(rows[p : p + 64])

    return run


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line of a group of equal keys with the earliest line that it may go for."""
    got: dict[int, list] = {}
    for batch in batches:
        for k, _, a, b in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
            got.setdefault(k, []).append((np.frombuffer(a, np.uint64).reshape(-1, 2), np.frombuffer(b, LINE)))
    while got:
        _, parts = got.popitem()
        key, line = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        whole, key = key[:, 1] == 1, key[:, 0]
        order = np.lexsort((line["n"], line["u"], line["d"], key))
        key, whole, line = key[order], whole[order], line[order]
        start = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(start) - 1
        head = np.flatnonzero(start)
        has_whole = np.bincount(group[whole], minlength=len(head)) > 0
        # the whole line of a group, and the earliest of its variants
        own = np.full(len(head), -1)
        own[group[whole][::-1]] = np.flatnonzero(whole)[::-1]
        var = np.full(len(head), -1)
        var[group[~whole][::-1]] = np.flatnonzero(~whole)[::-1]
        later = np.arange(len(key))
        # groups of replacements have no whole line; in others variants meet the whole line, and it the earliest variant
        against = np.where(has_whole[group], np.where(whole, var[group], own[group]), head[group])
        m = (against >= 0) & (against < later) & (line["h"][later] != line["h"][against])
        # in a group with a whole line, variants at one place meet in their own group
        a, b = line[later[m]], line[against[m]]
        pairs = np.unique(np.stack([a["h"], b["h"], a["u"].astype(np.uint64), a["n"].astype(np.uint64)], 1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, j].astype(np.int64)) for j in range(4)], names=["h", "other", "_uid", "n"])


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The earliest line of each kind of equal ones, as rows."""
    for batch in batches:
        for a in batch.column(2).to_pylist():
            x = np.frombuffer(a, LINE)
            yield pa.RecordBatch.from_arrays([pa.array(x["u"]), pa.array(x["d"]), pa.array(x["n"]), pa.array(x["h"].astype(np.int64)), pa.array(np.zeros(len(x), np.int32))], names=["_uid", "d", "n", "h", "code"])


def _pieces(bound: int, min_chars: int):
    """Keys of the pieces of each line (whole), and of the stretches that a piece of an equal or longer line may be.

    Of bound + 1 pieces one, the j-th, is left by the edits with at most j of them before it and bound - j behind it, which
    bounds its shift from either end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy()
            for lo, hi, buf in chunks(batch.column(1)):
                sym = _Symbols(buf)
                a, b = sym.at[buf.off[:-1]], sym.at[buf.off[1:]]
                keys, whole, of = [], [], []
                for longer in range(bound + 1):
                    m = b - a + longer
                    for j in range(bound + 1):
                        c, d = m * j // (bound + 1), m * (j + 1) // (bound + 1)
                        salt = mix(m.astype(np.uint64) * np.uint64(bound + 1) + np.uint64(j))
                        for shift in range(max(-j, j - bound - longer), min(j, bound - j - longer) + 1):
                            k = np.flatnonzero((b - a >= min_chars) & (c + shift >= 0) & (a + d + shift <= b))
                            key = mix(sym.raw(a[k] + c[k] + shift, a[k] + d[k] + shift) ^ salt[k])
                            for role in (True, False) if longer == shift == 0 else (False,):
                                keys.append(key)
                                whole.append(np.full(len(k), role))
                                of.append(h[lo:hi][k])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(whole)), pa.array(np.concatenate(of))], names=["key", "whole", "h"])

    return run


def _operations(sym: _Symbols, a: int, b: int, bound: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Keys of the variants of the code points [a, b), in parts, with their deletions and the deletions that are left to another line."""
    for t in range(min(bound, b - a) + 1):
        places = combinations(range(a, b), t)
        while part := list(islice(places, _PART)):
            at = np.fromiter(chain.from_iterable(part), np.int64).reshape(len(part), t)
            edges = np.concatenate([np.full((len(part), 1), a - 1), at, np.full((len(part), 1), b)], 1)
            left = np.zeros(len(part), np.uint64)
            back = np.full(len(part), sym.byte[a])
            for k in range(t + 1):
                s, e = sym.byte[edges[:, k] + 1], sym.byte[edges[:, k + 1]]
                left = reduced(left + sym.prefix.moved(sym.prefix.sum(s, e), back))
                if k < t:
                    back = back + sym.byte[edges[:, k + 1] + 1] - e
            for marked in product((False, True), repeat=t):
                marks, gone = np.zeros(len(part), np.uint64), 0
                for k, mark in enumerate(marked):
                    if mark:
                        marks = mix(marks + (at[:, k] - a - gone + 1).astype(np.uint64))
                    gone += not mark
                yield mix(left ^ marks), gone, bound - t


def _neighbours(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Variants of lines, with the line."""
        for batch in batches:
            line = [batch.column(j).to_numpy() for j in range(4)]
            for lo, _, buf in chunks(batch.column(4), 1 << 18):
                sym = _Symbols(buf)
                for k in range(buf.n):
                    for key, gone, room in _operations(sym, int(sym.at[buf.off[k]]), int(sym.at[buf.off[k + 1]]), bound):
                        own = [np.full(len(key), x[lo + k]) for x in line]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.astype(np.int64), np.full(len(key), gone, np.int32), np.full(len(key), room, np.int32), *own)], names=["key", "gone", "room", "_uid", "d", "n", "h"])

    return run


def _pairs_within(cut: DataFrame, bound: int, min_chars: int) -> DataFrame:
    """h, other, _uid, n: lines with an earlier one that shares a variant with them. Groups are reduced to their earliest lines, never expanded."""
    pieces = cut.select("h", "line").mapInArrow(_pieces(bound, min_chars), "key long, whole boolean, h long")
    ends = [f("h").alias(n) for f, n in ((F.min, "y0"), (F.max, "y1"))]
    ends += [f(F.when(F.col("whole"), F.col("h"))).alias(n) for f, n in ((F.min, "x0"), (F.max, "x1"))]
    met = pieces.groupBy("key").agg(*ends).where("x0 is not null and y0 <> y1")
    left = pieces.join(met.hint("merge"), "key").where("whole or x0 <> h or x1 <> h").select("h").distinct()
    lines = cut.join(left, "h", "left_semi").select("_uid", "d", "n", "h", "line")
    variants = lines.mapInArrow(_neighbours(bound), "key long, gone int, room int, _uid long, d long, n int, h long").withColumn("own", F.struct("d", "_uid", "n", "h"))
    first = variants.groupBy("key").agg(*[F.min(F.when(F.col("gone") <= k, F.col("own"))).alias(f"first{k}") for k in range(bound + 1)], F.min("h").alias("h0"), F.max("h").alias("h1")).where("h0 <> h1").drop("h0", "h1")
    earliest = F.coalesce(*[F.when(F.col("room") == k, F.col(f"first{k}")) for k in range(bound + 1)])
    found = variants.join(first.hint("merge"), "key").withColumn("earliest", earliest).where(F.col("earliest") < F.col("own"))
    return found.select("h", F.col("earliest.h").alias("other"), "_uid", F.col("n").cast("long").alias("n")).distinct()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dropped lines of each row."""
    got: dict[int, list] = {}
    for batch in batches:
        for k, a in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            got.setdefault(k, []).append(np.frombuffer(a, np.int64).reshape(-1, 2))
    for parts in got.values():
        x = np.unique(np.concatenate(parts), axis=0)
        first = np.flatnonzero(np.append(True, x[1:, 0] != x[:-1, 0]))
        yield pa.RecordBatch.from_arrays([pa.array(x[first, 0]), pa.ListArray.from_arrays(pa.array(np.append(first, len(x)), pa.int32()), pa.array(x[:, 1].astype(np.int32)))], names=["_uid", "exact"])


def _near_lists(found: DataFrame, texts: DataFrame, blocks: int, bound: int, min_chars: int) -> DataFrame:
    """_uid and near: the lines of each row that go for an earlier one within the bound."""
    spark = found.sparkSession
    if bound == 1:
        near = found.where(F.col("kind") != _DROP).repartition(blocks, "bucket").mapInArrow(_find, LISTED)
    else:
        near = found.where(F.col("kind") == _LINES).mapInArrow(_firsts, LISTED)
    near = shared(near.groupBy("_uid").agg(F.collect_list(F.struct("d", "n", "h", "code")).alias("listed")), spark)
    small = near.count() <= _BROADCAST_ROWS  # a row for each text with such lines; beyond that both sides are shuffled
    joined = texts.join(F.broadcast(near) if small else near, "_uid")
    cut = shared(joined.select("_uid", "listed", texts.columns[1]).mapInArrow(_cut, LISTED + ", line string"), spark)
    if bound == 1:
        pairs = cut.mapInArrow(_variants(blocks), SCHEMA).repartition(blocks, "bucket").mapInArrow(_pair, "h long, other long, _uid long, n long").distinct()
    else:
        pairs = _pairs_within(cut, bound, min_chars)
    left = cut.select(F.col("h"), F.col("line").alias("_l"))
    right = cut.select(F.col("h").alias("other"), F.col("line").alias("_r"))
    close = pairs.join(left, "h").join(right, "other").where(F.levenshtein("_l", "_r", bound).between(0, bound))
    return close.groupBy("_uid").agg(F.array_sort(F.collect_set(F.col("n").cast("int"))).alias("near"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, text: str = "text", key: str = "doc_id", counts: tuple[str, str, str] = ("n_lines", "n_exact", "n_near"), bound: int = 1) -> DataFrame:
    """docs with the lines that go taken out of the text, and three counts: lines that aren't blank, and those dropped as equal or as near."""
    if bound < 0:
        raise ValueError("the edit bound is a number of characters, 0 or more")
    spark: SparkSession = docs.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    names = docs.columns
    inner = [f"_c{j}" for j in range(len(names))]  # so that no name can clash
    at = names.index(text)
    placed = place(docs.toDF(*inner))
    line_text = inner[at]
    rows = placed.select("_uid", F.col(inner[names.index(key)]).cast("long").alias("_id"), line_text)
    found = shared(rows.mapInArrow(_scan(blocks, min_chars if bound == 1 else math.inf), SCHEMA).repartition(blocks, "bucket").mapInArrow(_settle(blocks), SCHEMA), spark)
    if bound:
        near_lists = _near_lists(found, placed.select("_uid", line_text), blocks, bound, min_chars)
    else:
        near_lists = spark.createDataFrame([], "_uid long, near array<int>")
    exact_lists = found.where(F.col("kind") == _DROP).repartition(blocks, "bucket").mapInArrow(_lists, "_uid long, exact array<int>")
    drops = exact_lists.join(near_lists, "_uid", "full")
    schema = StructType(docs.withColumn(text, F.col(text).cast("string")).schema.fields)
    for c in counts:
        while c.lower() in {x.lower() for x in schema.names}:
            c = "_" + c
        schema = schema.add(c, IntegerType())
    for f in schema.fields:
        f.nullable = True

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, close_ = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            kept, n = [], []
            for t, a, b in zip(batch.column(at).to_pylist(), exact, close_, strict=True):
                lines = (t or "").split("\n")
                n.append(sum(1 for x in lines if x.strip(" \t\n\v\f\r")))
                if a or b:
                    gone = {*(a or ()), *(b or ())}
                    t = "\n".join(x for k, x in enumerate(lines) if k not in gone)
                kept.append(t)
            cols = [pa.array(kept, pa.string()) if j == at else batch.column(j) for j in range(len(names))]
            dropped = [pa.array([len(x or ()) for x in xs], pa.int32()) for xs in (exact, close_)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32()), *dropped], names=schema.names)

    joined = placed.join(drops, "_uid", "left").select(*inner, "exact", "near")
    return joined.mapInArrow(rewrite, schema)
