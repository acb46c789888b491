"""Language-model scoring by deleted interpolation of word trigrams.

Tokens are words (A-Z lower-cased) and one end for each text; before a text stand two starts. The probability
of a token is a mixture of the maximum-likelihood estimates of orders 3, 2 and 1 over all words and of a
uniform share 1 / (V + 1). The weights depend on the longest history that the counts hold (of two words, of
one, or none) and on the binary logarithm of its frequency; orders whose history was never met have no
weight, so the probabilities of all V words and of the unknown word sum to 1. The weights are learned by
expectation-maximisation on held-out counts: a tenth of the training texts is left out of the counts while
they are learned (the final estimates use all training texts). It ends when a round adds less than 1e-6 to the
mean log probability of a held-out token, after 50 rounds at most.

At scale: texts are handled in units of about 4 MB. A unit sends its distinct words, bigrams and trigrams with
their counts, so a hot one is sent once by each, in packed blocks by hash range (sorted keys as differences); the
task of a range sums them and answers each unit with the sums in the order of its keys, at most a byte for most.
The counts grow with the corpus and none of them are dropped, gathered by the driver or broadcast. Shuffle files are given
up once what they lead to is written. Texts meet the answers by unit. The
count of a history is that of the word or bigram before the token, as something follows each of them. Grams are
known by 64-bit hashes. Units are formed twice, from the same rows in the same splits (their number is held for the session); if they
ever differed, the job would end with an error, not with other scores.

Defined cases: a null or empty text is a single end; very long texts are units of their own; repeated rows are scored each (rows are told
apart by their place); without training texts N and V are 0, both scores are 0 per token; an empty table gives an empty result;
further columns are ignored, whatever their names; a null id counts as the empty text for the training rule.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, pin_splits, place, shared
from .textbuf import CHUNK_BYTES, Buf, chunks, mix

END = np.uint64(0x5EED0E4D5EED0E4D)
START = np.uint64(0x57A2757A2757A275)
_ODD = np.uint64(0xD6E8FEB86659FD93)
UNIT_BYTES = 4 << 20
_SPLIT = 1 << 19
BUCKETS = 128
ROUNDS = 50


def _small(buf: Buf) -> Iterator[tuple[int, Buf]]:
    lo = 0
    while lo < buf.n:
        hi = max(lo + 1, int(np.searchsorted(buf.off, buf.off[lo] + CHUNK_BYTES, side="right")) - 1)
        yield lo, Buf(buf.data[buf.off[lo] : buf.off[hi]], buf.off[lo : hi + 1] - buf.off[lo])
        lo = hi


def tokens(buf: Buf) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with each text's end, and text numbers."""
    if buf.n > 1 and len(buf.data) > CHUNK_BYTES:
        parts = [(lo, *tokens(part)) for lo, part in _small(buf)]
        return np.concatenate([h for _, h, _ in parts]), np.concatenate([lo + doc for lo, _, doc in parts])
    s, e, doc = buf.words()
    h = buf.hashes(s, e, lower=True)
    at = np.searchsorted(doc, np.arange(buf.n), side="right")  # a text's end goes after its words
    return np.insert(h, at, END), np.insert(doc, at, np.arange(buf.n))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Blocks by the high bits of the hash, in the order of the keys."""
    return ((keys >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def grams(h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For orders 1 to 3 the distinct grams, sorted, and which of them ends at each token."""
    yield np.unique(h, return_inverse=True)
    new = np.append(True, doc[1:] != doc[:-1])
    v = np.roll(h, 1)
    v[new] = START
    two = mix(v * _ODD + h)
    del v
    yield np.unique(two, return_inverse=True)
    before = np.roll(two, 1)
    before[new] = mix(np.array([START]) * _ODD + START)[0]
    del two
    yield np.unique(mix(before * _ODD + h), return_inverse=True)


def pack(x: np.ndarray) -> bytes:
    """Counts in a byte each, compressed; those of 255 and more follow."""
    return zlib.compress(np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.int64).tobytes(), 1)


def unpack(raw: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(raw)
    x = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    big = np.frombuffer(raw[n:], np.int64)
    if len(x) != n or np.count_nonzero(x == 255) != len(big):
        raise ValueError("counts don't fit their keys")
    x[x == 255] = big
    return x


def pack_keys(k: np.ndarray) -> bytes:
    """Sorted keys as differences of the width that takes least; those that need more follow in full."""
    if not len(k):
        return b""
    d = np.diff(k, prepend=np.uint64(0))
    w = min((5, 6, 7), key=lambda w: len(d) * w + 8 * np.count_nonzero(d >= np.uint64(256**w - 1)))
    top = np.uint64(256**w - 1)
    low = np.minimum(d, top).view(np.uint8).reshape(-1, 8)[:, :w]
    return bytes([w]) + len(d).to_bytes(7, "little") + low.tobytes() + d[d >= top].tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    w, n = raw[0], int.from_bytes(raw[1:8], "little")
    full = np.zeros((n, 8), np.uint8)
    full[:, :w] = np.frombuffer(raw[8 : 8 + n * w], np.uint8).reshape(n, w)
    d = full.view(np.uint64).ravel()
    d[d == np.uint64(256**w - 1)] = np.frombuffer(raw[8 + n * w :], np.uint64)
    return np.cumsum(d, dtype=np.uint64)


def _parts(kind: np.ndarray) -> Iterator[tuple[bool, np.ndarray]]:
    """The texts of a unit that are left out of the counts while weights are learned, and the others."""
    for left in (False, True):
        rows = np.flatnonzero((kind == 2) == left)
        if len(rows):
            yield left, rows


def _pick(buf: Buf, rows: np.ndarray) -> Buf:
    off = np.append(0, np.cumsum(buf.off[rows + 1] - buf.off[rows]))
    return Buf(np.concatenate([buf.data[buf.off[k] : buf.off[k + 1]] for k in rows]), off)


_KEYS = "bucket int, unit long, left boolean, " + ", ".join(f"k{j} binary" for j in range(3)) + ", " + ", ".join(f"m{j} binary" for j in range(3))
_SUMS = "unit long, left boolean, bucket int, " + ", ".join(f"x{j} binary" for j in range(6))
_STATS = ("n", "v", "texts", "n_kept", "texts_kept")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[t]) for j, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


def _cuts(keys: np.ndarray, blocks: int, first: int = 0, n: int | None = None) -> np.ndarray:
    """Where the blocks from the first on begin in sorted keys."""
    return np.searchsorted(bucket_of(keys, blocks), np.arange(first, first + (blocks if n is None else n) + 1))


def _send_grams(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, kinds = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, buf in chunks(batch.column(1), UNIT_BYTES):
                kind = kinds[lo:hi]
                for left, rows in _parts(kind):
                    h, doc = tokens(_pick(buf, rows))
                    weight = (kind[rows] > 0).astype(float)[doc]
                    keys, counts = [], []
                    for u, back in grams(h, doc):
                        m = np.bincount(back, weights=weight, minlength=len(u)).astype(np.int64)
                        cut = _cuts(u, blocks)
                        at = [slice(x, y) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                        keys.append([pack_keys(u[x]) for x in at])
                        counts.append([pack(m[x]) for x in at])
                    out = [(b, int(uids[lo]), left, *(k[b] for k in keys), *(m[b] for m in counts)) for b in range(blocks) if any(k[b] for k in keys)]
                    for k in range(0, len(out), 64):
                        yield _batch(out[k : k + 64], _KEYS)

    return run


def _answer(blocks: int):
    """Sums the counts of each block and answers each unit; x0 to x2 are all counts, x3 to x5 those without the texts left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: dict[int, list[tuple]] = {}
        for batch in batches:
            for r in zip(*(batch.column(j).to_pylist() for j in range(9)), strict=True):
                wait.setdefault(r[0], []).append(r[1:])
        while wait:
            bucket, asked = wait.popitem()
            left = np.array([r[1] for r in asked])
            answers: list[list[bytes]] = [[b""] * 6 for _ in asked]
            stats = np.zeros(5, np.int64)
            for j in range(3):
                keys = [unpack_keys(r[2 + j]) for r in asked]
                m = [unpack(r[5 + j], len(k)) for r, k in zip(asked, keys, strict=True)]
                parts = 1 + sum(map(len, keys)) // _SPLIT  # large blocks are summed by parts of their range
                cuts = [_cuts(k, blocks * parts, bucket * parts, parts) if parts > 1 else [0, len(k)] for k in keys]
                counts: list[list[np.ndarray]] = [[] for _ in asked]
                kept: list[list[np.ndarray]] = [[] for _ in asked]
                for p in range(parts):
                    at = [slice(c[p], c[p + 1]) for c in cuts]
                    size = [x.stop - x.start for x in at]
                    u, back = np.unique(np.concatenate([k[x] for k, x in zip(keys, at, strict=True)]), return_inverse=True)
                    w = np.concatenate([y[x] for y, x in zip(m, at, strict=True)])
                    c = np.bincount(back, weights=w, minlength=len(u)).astype(np.int64)
                    a = c - np.bincount(back, weights=w * np.repeat(left, size), minlength=len(u)).astype(np.int64)
                    if j == 0:
                        end = u == END
                        stats += [c.sum(), (c > 0).sum(), c[end].sum(), a.sum(), a[end].sum()]
                    hi = 0
                    for k in range(len(asked)):
                        lo, hi = hi, hi + size[k]
                        counts[k].append(c[back[lo:hi]])
                        if left[k]:
                            kept[k].append(a[back[lo:hi]])
                for k, out in enumerate(answers):
                    out[j] = pack(np.concatenate(counts[k]))
                    if left[k]:
                        out[3 + j] = pack(np.concatenate(kept[k]))
            schema = _SUMS + "".join(f", {x} long" for x in _STATS)
            for lo in range(0, len(asked), 64):
                yield _batch([(r[0], r[1], bucket, *x, *(stats.tolist() if lo + k == 0 else [0] * 5)) for k, (r, x) in enumerate(zip(asked[lo : lo + 64], answers[lo : lo + 64], strict=True))], schema)

    return run


def _send_texts(only_left: bool):
    """Rows of bucket -1: places of the texts, their offsets and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, kinds = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, buf in chunks(batch.column(1), UNIT_BYTES):
                for left, rows in _parts(kinds[lo:hi]):
                    if left or not only_left:
                        part = _pick(buf, rows)
                        yield _batch([(int(uids[lo]), left, -1, uids[lo:hi][rows].tobytes(), part.off.tobytes(), part.data.tobytes(), b"", b"", b"")], _SUMS)

    return run


def _meet(batches: Iterator[pa.RecordBatch], blocks: int, first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each unit the places of its texts, each token's text, the first tokens, and counts of orders 1 to 3 from column x[first] on."""
    texts: dict[tuple, tuple] = {}
    sums: dict[tuple, dict[int, tuple]] = {}
    for batch in batches:
        for r in zip(*(batch.column(j).to_pylist() for j in range(9)), strict=True):
            if r[2] < 0:
                texts[r[:2]] = r[3:6]
            else:
                sums.setdefault(r[:2], {})[r[2]] = r[3 + first : 6 + first]
    if texts.keys() != sums.keys():
        raise ValueError("units of texts and of counts differ")
    while texts:
        unit, (uid, off, data) = texts.popitem()
        got = sums.pop(unit)
        h, doc = tokens(Buf(np.frombuffer(data, np.uint8), np.frombuffer(off, np.int64)))
        new = np.append(True, doc[1:] != doc[:-1])
        counts = []
        for j, (u, back) in enumerate(grams(h, doc)):
            size = np.diff(_cuts(u, blocks))
            counts.append(np.concatenate([unpack(got[b][j], int(size[b])) for b in np.flatnonzero(size)])[back])
        yield np.frombuffer(uid, np.int64), doc, new, counts


def estimates(counts: list[np.ndarray], new: np.ndarray, texts: int, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights' bucket of each token and its estimates of orders 3, 2, 1 and 0."""
    one, two, three = counts
    h1, h2 = (np.where(new, texts, np.roll(x, 1)) for x in (one, two))  # something follows every word and bigram
    log = lambda x: np.log2(np.maximum(x, 1)).astype(np.int64)
    bucket = np.where(h2 > 0, BUCKETS // 2 + log(h2), np.where(h1 > 0, 1 + log(h1), 0))
    return bucket, np.stack([three / np.maximum(h2, 1), two / np.maximum(h1, 1), one / max(n, 1), np.full(len(one), 1 / (v + 1))], 1)


def learn_weights(events: DataFrame, v: int) -> np.ndarray:
    """Weights of orders 3, 2, 1 and 0 by bucket; an order whose history was never met has none."""
    met = np.ones((BUCKETS, 4))
    met[: BUCKETS // 2, 0] = 0
    met[0, 1] = 0
    weights, last = met / met.sum(1, keepdims=True), -np.inf

    def expect(w: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, gain = np.zeros((BUCKETS, 4)), 0.0
            for batch in batches:
                for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    bucket = np.frombuffer(b, np.uint8)
                    r = np.append(np.frombuffer(p, np.float32).reshape(-1, 3), np.full((len(bucket), 1), 1 / (v + 1)), 1) * w[bucket]
                    s = r.sum(1)
                    gain += float(np.log(s).sum())
                    r /= s[:, None]
                    total += np.stack([np.bincount(bucket, weights=r[:, j], minlength=BUCKETS) for j in range(4)], 1)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([gain])], names=["r", "gain"])

        return run

    tasks = 2 * events.sparkSession.sparkContext.defaultParallelism
    for _ in range(ROUNDS):
        rows = events.coalesce(tasks).mapInArrow(expect(weights), "r binary, gain double").collect()
        total = sum((np.frombuffer(r["r"], float).reshape(BUCKETS, 4) for r in rows), np.zeros((BUCKETS, 4)))
        new = total + 1e-3 * met
        weights = new / new.sum(1, keepdims=True)
        gain = sum(r["gain"] for r in rows) / max(total.sum(), 1)
        if gain - last < 1e-6:
            break
        last = gain
    # with a floor, so that a word never met always has a positive probability
    return weights * (1 - 1e-4) + np.array([0, 0, 0, 1e-4])


def lm_scores(docs: DataFrame, held_mod: int = 7, held_rest: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score of every row of docs.

    key is of an integer kind.
    """
    spark: SparkSession = docs.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    pin_splits(spark)
    placed = place(docs.select(key, text))
    left = F.abs(F.xxhash64(F.coalesce(F.col(key), F.lit(0)).cast("string"), F.lit(3))) % 10 == 0
    units = placed.select("_uid", text, F.when(crc_mod(key, held_mod) == held_rest, 0).when(left, 2).otherwise(1).alias("kind"))
    counted = units.mapInArrow(_send_grams(blocks), _KEYS).repartition(blocks, "bucket").mapInArrow(_answer(blocks), _SUMS + "".join(f", {x} long" for x in _STATS))
    answers = shared(counted, spark)
    n, v, n_texts, n_kept, kept_texts = (x or 0 for x in answers.agg(*(F.sum(x) for x in _STATS)).first())

    def met(only_left: bool) -> DataFrame:
        got = (answers.where("left") if only_left else answers).drop(*_STATS)
        return units.mapInArrow(_send_texts(only_left), _SUMS).union(got).repartition(blocks, "unit", "left")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, new, counts in _meet(batches, blocks, 3):
            bucket, p = estimates(counts, new, kept_texts, n_kept, v)
            yield pa.RecordBatch.from_arrays([pa.array([bucket.astype(np.uint8).tobytes()], pa.binary()), pa.array([p[:, :3].astype(np.float32).tobytes()], pa.binary())], names=["bucket", "p"])

    weights = np.zeros((BUCKETS, 4))
    if n:
        told = met(True).mapInArrow(held, "bucket binary, p binary")
        weights = learn_weights(shared(told, spark), v)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, doc, new, counts in _meet(batches, blocks, 0):
            size = np.bincount(doc, minlength=len(uid))
            known, s1, s2 = np.zeros(len(uid), np.int64), np.zeros(len(uid)), np.zeros(len(uid))
            if n:
                bucket, p = estimates(counts, new, n_texts, n, v)
                known = np.bincount(doc[counts[0] > 0], minlength=len(uid))
                s1 = np.bincount(doc, weights=np.log10((counts[0] + 1) / (n + v + 1)), minlength=len(uid))
                s2 = np.bincount(doc, weights=np.log10((p * weights[bucket]).sum(1)), minlength=len(uid))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid, size, known, s1, s2)], names=["_uid", "n_tokens", "n_known", "base_score", "score"])

    result = met(False).mapInArrow(score, "_uid long, n_tokens long, n_known long, base_score double, score double")
    ids = placed.select("_uid", key, (crc_mod(key, held_mod) == held_rest).alias("held_out"))
    return ids.join(result, "_uid").select(key, "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
