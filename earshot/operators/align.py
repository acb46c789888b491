"""Alignment of token sequences into substitutions, deletions and insertions.

An Arrow UDF aligns a whole batch of pairs at once: pairs of similar length are padded together and the table of
edit costs is filled along its anti-diagonals, on which no cell depends on another. A match always takes
the diagonal; of equal costs a substitution comes before a deletion, and that before an insertion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.text import NormalizerConfig, char_tokens, normalize, word_tokens
from earshot.functions.types import COUNTS

_CELLS = 2_000_000
_FIELD = 21  # bits of each of three counts
_DEL, _INS = np.int64(1) << _FIELD, np.int64(1) << 2 * _FIELD


def _fill(ref: np.ndarray, hyp: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Packed counts for padded pairs: substitutions, deletions << 21, insertions << 42.

    A diagonal is a block of consecutive table rows for all pairs, so every step works on contiguous memory.
    """
    pairs, rows, cols = len(n), ref.shape[1], hyp.shape[1]
    ref, back = np.ascontiguousarray(ref.T), np.ascontiguousarray(hyp.T[::-1])
    cost = [np.full((rows + 1, pairs), 1 << 30, np.int32) for _ in range(3)]
    ops = [np.zeros((rows + 1, pairs), np.int64) for _ in range(3)]
    ends: dict[int, np.ndarray] = {}
    order = np.argsort(n + m, kind="stable")
    total = (n + m)[order]
    for d in np.unique(total).tolist():
        ends[d] = order[np.searchsorted(total, d) : np.searchsorted(total, d, side="right")]
    out = np.zeros(pairs, np.int64)
    for d in range(int(total[-1]) + 1 if pairs else 0):
        c, o = cost[d % 3], ops[d % 3]
        c1, o1, c2, o2 = cost[(d - 1) % 3], ops[(d - 1) % 3], cost[(d - 2) % 3], ops[(d - 2) % 3]
        lo, hi = max(1, d - cols), min(rows, d - 1)
        if lo <= hi:
            here, up = slice(lo, hi + 1), slice(lo - 1, hi)
            same = ref[up] == back[cols - d + lo : cols - d + hi + 1]
            dele = c1[up] <= c1[here]
            other = np.where(dele, c1[up], c1[here])
            sub = c2[up] <= other
            sub |= same
            best = np.where(sub, c2[up], other)
            best += ~same
            moved = np.where(dele, o1[up] + _DEL, o1[here] + _INS)
            np.copyto(moved, o2[up] + ~same, where=sub)
            c[here], o[here] = best, moved
        if d <= cols:
            c[0], o[0] = d, d * _INS
        if d <= rows:
            c[d], o[d] = d, d * _DEL
        if d in ends:
            out[ends[d]] = o[n[ends[d]], ends[d]]
    return out


def align_codes(ref: np.ndarray, n: np.ndarray, hyp: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rows of substitutions, deletions, insertions and reference length for sequences of token codes, one after the other, and their lengths."""
    if len(n) and (n + m).max() >= 1 << _FIELD:
        raise ValueError(f"sequences of {1 << _FIELD} tokens and more can't be aligned")
    packed = np.zeros(len(n), np.int64)
    start, begin = np.cumsum(n) - n, np.cumsum(m) - m
    order = np.lexsort((m, n))
    at = 0
    while at < len(order):
        size = n[order[at]] + 1
        to = at + 1
        while to < len(order) and to - at < 512 and (to - at + 1) * (n[order[to]] + 1) <= _CELLS // 4 and n[order[to]] <= 1.3 * size + 4:
            to += 1
        part = order[at:to]
        padded = []
        for codes, first, length, filler in ((ref, start, n, -1), (hyp, begin, m, -2)):
            size, table = length[part], np.full((len(part), int(length[part].max(initial=0))), filler, np.int32)
            inside = np.arange(table.shape[1])[None, :] < size[:, None]
            table[inside] = codes[np.repeat(first[part] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            padded.append(table)
        packed[part] = _fill(*padded, n[part], m[part])
        at = to
    mask = (1 << _FIELD) - 1
    return np.column_stack([packed & mask, packed >> _FIELD & mask, packed >> 2 * _FIELD & mask, n])


def align_counts(refs: list, hyps: list) -> np.ndarray:
    """As align_codes, for lists of token sequences."""
    codes: dict = {}
    numbers = [np.array([codes.setdefault(t, len(codes)) for x in side for t in x], np.int32) for side in (refs, hyps)]
    n, m = (np.array([len(x) for x in side], np.int64) for side in (refs, hyps))
    return align_codes(numbers[0], n, numbers[1], m)


@F.arrow_udf(COUNTS)
def _aligned(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Tokens of a batch become codes in one pass; null counts as no tokens."""
    sides = [x.flatten() for x in (ref, hyp)]
    codes = pa.concat_arrays([x.cast(pa.string()) for x in sides]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int32)
    n, m = (x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ref, hyp))
    x = align_codes(codes[: len(sides[0])], n, codes[len(sides[0]) :], m)
    return pa.StructArray.from_arrays([pa.array(x[:, j], pa.int64()) for j in range(4)], names=COUNTS.names)


def error_counts(ref_tokens: Column, hyp_tokens: Column) -> Column:
    """A struct of substitutions, deletions, insertions and reference_length."""
    return _aligned(ref_tokens, hyp_tokens)


def word_errors(reference: Column, hypothesis: Column, cfg: NormalizerConfig = NormalizerConfig(), unicode: bool = True) -> Column:
    return error_counts(word_tokens(normalize(reference, cfg, unicode)), word_tokens(normalize(hypothesis, cfg, unicode)))


def char_errors(reference: Column, hypothesis: Column, cfg: NormalizerConfig = NormalizerConfig(), unicode: bool = True) -> Column:
    return error_counts(char_tokens(normalize(reference, cfg, unicode)), char_tokens(normalize(hypothesis, cfg, unicode)))


def score(results: DataFrame, cfg: NormalizerConfig = NormalizerConfig(), unicode: bool = True) -> DataFrame:
    """Results with counts and wer recomputed from the stored texts."""
    from .aggregate import rate

    old = ["substitutions", "deletions", "insertions", "reference_words", "wer"]
    x = results.drop(*old).withColumn("_e", word_errors(F.col("reference"), F.col("hypothesis"), cfg, unicode))
    x = x.select("*", "_e.substitutions", "_e.deletions", "_e.insertions", F.col("_e.reference_length").alias("reference_words")).drop("_e")
    return x.withColumn("wer", rate(F.col("substitutions") + F.col("deletions") + F.col("insertions"), F.col("reference_words")))


def corpus_wer(pairs: DataFrame | list[tuple[str, str]], cfg: NormalizerConfig = NormalizerConfig()) -> DataFrame:
    """Pooled counts and wer of all pairs (reference, hypothesis), one row."""
    from .aggregate import pooled

    return pooled(score(_pairs(pairs), cfg))


def _pairs(pairs: DataFrame | list[tuple[str, str]]) -> DataFrame:
    if isinstance(pairs, DataFrame):
        return pairs
    return SparkSession.active().createDataFrame(pairs, "reference string, hypothesis string")
