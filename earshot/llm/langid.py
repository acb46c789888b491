"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (n = 1 to 3) of lower-cased code points, everything that is no letter counting
as a space. Term frequency is the share among a text's n-grams; document frequencies are counted over all
training documents. Weights are trained by the follow-the-regularised-leader rule with elastic-net
penalties on a bounded sample (`per_language` texts for each language, those of the smallest id hashes: a
documented bound), and one temperature is then fitted on the fifth of the sample left out of training.

Defined cases: a null or empty text or one without a letter is `und` with score 1.0; rows with a null
language or text do not train; with no training rows everything else is `und` with score 0.0; ties between
languages go to the smaller code; equal texts get equal results; repeated ids count each row once, so they don't
widen the sample; very long texts count whole; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, place
from .textbuf import Buf, chunks

BITS = 15
SIZE = 1 << BITS
_BLOCKS = 16
_letters: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> lower-case code point, or 32 for what is no letter."""
    if not _letters:
        t = np.full(0x110000, 32, np.uint32)
        for k in range(0x110000):
            if chr(k).isalpha():
                t[k] = ord(chr(k).lower()[0])
        _letters.append(t)
    return _letters[0]


def grams(buf: Buf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of the n-grams (3 for each code point) as an array by code point, offsets by code point, and whether each text has letters."""
    c = np.zeros(len(buf.data) + 1, np.int64)
    np.cumsum((buf.data & 0xC0) != 0x80, out=c[1:])
    off = c[buf.off]
    cp = np.frombuffer(buf.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    x = _fold()[cp]
    letter = x != 32
    head = np.zeros(len(x) + 2, bool)
    head[off[:-1]] = True
    y = x * np.uint32(0x9E3779B1)
    one = np.concatenate([[np.uint32(0)], y]).astype(np.uint32)[: len(x)]
    one[head[: len(x)]] = 0  # before a text comes nothing
    two = np.concatenate([np.zeros(2, np.uint32), y]).astype(np.uint32)[: len(x)]
    two[head[: len(x)]] = 0
    two[1:][head[: max(len(x) - 1, 0)]] = 0
    shift = np.uint32(32 - BITS)
    a = (y ^ np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    b = y * np.uint32(0x27D4EB2F) + one * np.uint32(0x165667B1)
    d = (b ^ (b >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + two * np.uint32(0x297A2D39)
    b = (b ^ (b >> np.uint32(13))) * np.uint32(0x85EBCA77)
    d = (d ^ (d >> np.uint32(14))) * np.uint32(0x9E3779B1)
    f = np.stack([(a ^ (a >> np.uint32(16))) * np.uint32(0x85EBCA6B) >> shift, b >> shift, d >> shift])
    has = np.zeros(buf.n, bool)
    k = np.concatenate([[0], np.cumsum(letter)])
    has[:] = k[off[1:]] > k[off[:-1]]
    return f.astype(np.int64), off, has, np.diff(off)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for _, _, buf in chunks(batch.column(0), 1 << 20):
            f, off, _, length = grams(buf)
            doc = np.repeat(np.arange(buf.n), length)
            for lo in range(0, buf.n, 64):
                hi = min(lo + 64, buf.n)
                seen = np.zeros((hi - lo, SIZE), bool)
                rows = doc[off[lo] : off[hi]] - lo
                for x in f:
                    seen[rows, x[off[lo] : off[hi]]] = True
                df += seen.sum(0)
            n += buf.n
    if n:
        parts = [df[k * SIZE // _BLOCKS : (k + 1) * SIZE // _BLOCKS] for k in range(_BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([n] * _BLOCKS, pa.int64())], names=["block", "df", "n"])


def _add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the vectors of each block met in this task."""
    found: dict[int, list] = {}
    for batch in tables:
        for block, df, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            got = found.setdefault(block, [np.zeros(SIZE // _BLOCKS, np.int64), 0])
            got[0] += np.frombuffer(df, np.int64)
            got[1] += n
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v[0].tobytes() for v in found.values()], pa.binary()), pa.array([v[1] for v in found.values()], pa.int64())], names=["block", "df", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf in chunks(batch.column(2)):
            f, off, has, length = grams(buf)
            ids, tf = [], []
            for k in range(buf.n):
                u, c = np.unique(f[:, off[k] : off[k + 1]], return_counts=True)
                ids.append(u.astype(np.int32).tobytes())
                tf.append((c / max(1, 3 * length[k])).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(tf, pa.binary())], names=["lang", "h", "ids", "tf"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, seed: int = 3) -> np.ndarray:
    """Weights (features, classes) of a softmax model by follow-the-regularised-leader with per-coordinate rates."""
    z, n = np.zeros((SIZE, classes)), np.zeros((SIZE, classes))
    rng = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, x, y = rows[k]
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            t = x @ w
            p = np.exp(t - t.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[ids] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[ids] = ni + g2
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The T that minimises the loss of softmax(logits / T), by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 500) -> tuple[list[str], np.ndarray]:
    """Languages and a table (features, languages) whose mean over a text's n-grams gives its calibrated logits."""
    rows = place(docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("_key"), F.col(lang).alias("lang"), F.col(text).alias("text")))
    text = "text"
    parts = rows.select(text).mapInArrow(_document_frequencies, "block int, df binary, n long").repartition(_BLOCKS, "block").mapInArrow(_add, "block int, df binary, n long").collect()
    df, total = np.zeros(SIZE), 0
    for r in parts:
        df[r["block"] * SIZE // _BLOCKS : (r["block"] + 1) * SIZE // _BLOCKS] = np.frombuffer(r["df"], np.int64)
        total = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    h = F.xxhash64(F.col("_key").cast("string"), F.lit(5)).alias("h")
    # in two steps, so that a frequent language is never ranked in one task: 64 shares first, then what they leave
    picked = rows.select("_uid", "lang", h).withColumn("_share", F.pmod("h", F.lit(64)))
    for part in (["lang", "_share"], ["lang"]):
        picked = picked.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy("h", "_uid"))).where(F.col("_r") <= per_language)
    sample = rows.join(F.broadcast(picked.select("_uid")), "_uid").select("lang", h, "text")  # per_language rows for each language
    got = sorted((r["lang"], r["h"], bytes(r["ids"]), bytes(r["tf"])) for r in sample.mapInArrow(_sparse, "lang string, h long, ids binary, tf binary").collect())
    langs = sorted({r[0] for r in got})
    data = []
    for lg, h, ids, tf in got:
        i = np.frombuffer(ids, np.int32).astype(np.int64)
        data.append((i, np.frombuffer(tf, np.float32) * idf[i] * 10, langs.index(lg), h % 5 == 0))
    w = ftrl([d[:3] for d in data if not d[3]], len(langs)) if langs else np.zeros((SIZE, 0))
    left = [d for d in data if d[3]] or data
    t = temperature(np.array([d[1] @ w[d[0]] for d in left]), np.array([d[2] for d in left])) if len(langs) > 1 else 1.0
    return langs, (w * idf[:, None] * 10 / t).astype(np.float32)


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two further columns, named by out: the language and its probability."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    at = len(docs.columns)
    schema = StructType(list(docs.schema.fields)).add(out[0], StringType()).add(out[1], DoubleType())
    codes = np.array([*langs, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf in chunks(batch.column(at), 1 << 20):
                f, off, has, length = grams(buf)
                logit = np.zeros((buf.n, len(langs)))
                full = np.flatnonzero(length > 0)
                if len(full) and len(langs):
                    for x in f:
                        logit[full] += np.add.reduceat(table[x], off[:-1][full], axis=0, dtype=np.float64)
                    logit[full] /= 3 * length[full, None]
                best, p = np.full(buf.n, len(langs)), np.where(has, 0.0, 1.0)
                if len(langs):
                    q = np.exp(logit - logit.max(1, keepdims=True))
                    q /= q.sum(1, keepdims=True)
                    best = np.where(has, q.argmax(1), len(langs))
                    p = np.where(has, q.max(1), 1.0)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(at)), pa.array(codes[best], pa.string()), pa.array(p)], names=schema.names)

    inner = [f"_c{j}" for j in range(at)]  # so that no name can clash
    return docs.toDF(*inner).select(*inner, F.col(inner[docs.columns.index(text)]).alias("_text")).mapInArrow(run, schema)


def language_id(docs: DataFrame, held_mod: int = 4, held_rest: int = 2, per_language: int = 500, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """key, held_out, lang_pred and score of every row, learned from the rows that are not held out."""
    langs, table = train(docs.where(crc_mod(key, held_mod) != held_rest), text, lang, key, per_language)
    found = identify(docs.select(key, text), langs, table, text)
    return found.select(key, (crc_mod(key, held_mod) == held_rest).alias("held_out"), "lang_pred", "score")
