"""Quality rules: share of characters inside duplicated word n-grams and lines.

Rolling 64-bit hashes of word n-grams of several lengths, in numpy, over whole texts. A window of n words
can repeat only if the shorter windows inside it do, so longer lengths look only at windows whose
shortest windows all repeat.

Defined cases: a null text counts as empty (no words, base_failed, not kept); texts without words have
shares of 0; equal rows each get their own result; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbuf import Buf, chunks, mix, twice, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Largest allowed shares of word characters inside repeated n-grams (by n) and repeated lines."""

    ngram_share: dict = field(default_factory=lambda: {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25})
    line_share: float = 0.30
    symbol_share: float = 0.10
    min_words: int = 50


def measure(buf: Buf, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of each text of buf: words, characters in words, symbols, repeated lines, and repeated coverage."""
    s, e, doc = buf.words()
    n = buf.n
    chars = (buf.data & 0xC0) != 0x80
    c = np.zeros(len(buf.data) + 1, np.int64)
    np.cumsum(chars, out=c[1:])
    width = c[e] - c[s]
    per = lambda x, w=None: np.bincount(x, weights=w, minlength=n)
    out = {
        "n_words": per(doc).astype(np.int64),
        "word_chars": per(doc, width).astype(np.int64),
        "n_symbols": buf.per_doc(_SYMBOL[buf.data]),
    }
    h = buf.hashes(s, e)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    # lines
    ls, le, ld = buf.lines()
    first = np.searchsorted(s, ls)
    has = (first < len(s)) & (np.append(s, len(buf.data) + 1)[first] < le) if len(s) else np.zeros(len(ls), bool)
    ls, le, ld = ls[has], le[has], ld[has]
    key = buf.hashes(ls, le) ^ salt[ld] if len(ls) else np.zeros(0, np.uint64)
    _, at = np.unique(key, return_index=True)  # the first of equal lines
    again = np.ones(len(ls), bool)
    again[at] = False
    cw = np.concatenate([[0], np.cumsum(width)])
    in_line = cw[np.searchsorted(s, le)] - cw[np.searchsorted(s, ls)]
    both = twice(key) if len(key) else again
    out["n_lines"] = per(ld).astype(np.int64)
    out["n_dup_lines"] = per(ld[again]).astype(np.int64)
    out["dup_line_chars"] = per(ld[both], in_line[both]).astype(np.int64)
    # word windows
    short = np.zeros(len(s) + 1, bool)
    cover = np.zeros(len(s), bool)
    if len(s) >= 3:
        w, at = windows(h, doc, 3)
        hit = at[twice(w ^ salt[doc[at]])]
        short[hit] = True
        cover = _cover(hit, 3, len(s))
    out["n_repeat_words"] = per(doc[cover]).astype(np.int64)
    for k in lengths:
        m = len(s) - k + 1
        hit = np.zeros(0, np.int64)
        if m > 0:
            run = short[:m].copy()
            for j in range(1, k - 2):
                run &= short[j : j + m]
            at = np.flatnonzero(run & (doc[:m] == doc[k - 1 :]))
            if len(at):
                x = np.zeros(len(at), np.uint64)
                for j in range(k):
                    x = x * np.uint64(0xD6E8FEB86659FD93) + h[at + j]
                hit = at[twice(mix(x) ^ salt[doc[at]])]
        inside = _cover(hit, k, len(s))
        out[f"dup_{k}"] = per(doc[inside], width[inside]).astype(np.int64)
    return out


def _cover(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Marks the k places from each of at on."""
    d = np.zeros(n + k + 1, np.int32)
    np.add.at(d, at, 1) if len(at) < 64 else d.__iadd__(np.bincount(at, minlength=len(d)).astype(np.int32))
    c = np.cumsum(d)
    return (c - np.concatenate([np.zeros(k, c.dtype), c[:-k]]))[:n] > 0


def repetition_quality(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: its measures, base_failed and kept."""
    lengths = tuple(sorted(rules.ngram_share))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", *(f"dup_{k}" for k in lengths)]
    kind = dict(docs.select(key).dtypes)[key]
    schema = f"{key} {kind}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf in chunks(batch.column(1)):
                x = measure(buf, lengths)
                failed = (x["n_words"] < rules.min_words) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
                ok = ~failed & (x["dup_line_chars"] <= rules.line_share * x["word_chars"]) & (x["n_symbols"] <= rules.symbol_share * x["word_chars"])
                for k in lengths:
                    ok &= x[f"dup_{k}"] <= rules.ngram_share[k] * x["word_chars"]
                cols = [batch.column(0).slice(lo, hi - lo), *(pa.array(x[c]) for c in names), pa.array(failed), pa.array(ok)]
                yield pa.RecordBatch.from_arrays(cols, names=[key, *names, "base_failed", "kept"])

    return docs.select(key, text).mapInArrow(run, schema)
