"""Quality classifier: Bradley-Terry pairwise ranking.

Documents are described by shares and averages over their whole text, hashed words and hashed byte trigrams among them. Preference pairs (a document of
label 1 over one of label 0) give a logistic loss on feature differences; its minimiser is a weight
vector, and a document's utility is its weighted feature sum. The utility is cut at the quantile of the
training utilities that leaves the training share of label 1 above it, and mapped to (0, 1) so that this
cut has the score `threshold`.

Means, weights and cut come from all labelled training rows and all their pairs, none of which is made: a pair's loss depends on
the difference of two utilities only, so each round counts utilities on a grid (interpolated there by polynomials of degree 5, which
is exact to about 1e-9 a pair) and a convolution gives every row the sum over its opponents. The gradient is that of all pairs;
the matrix of second derivatives, which changes the way and not the end, uses a coarser grid. Features are computed once and
written; training rows lie in blocks dealt by hash of their place, and sums over blocks are whole numbers (fixed point),
so the result doesn't depend on the order of tasks. The cut is an exact order statistic, found by 16 bits a pass.

Defined cases: a null text counts as empty and gets the score of an empty text; null labels and labels
without a document are ignored; several labels of one id count as 1 if their mean is 0.5 or more, and of several documents
of one id the first in the table trains; equal texts get equal scores; very long texts count whole; without both labels in the
training rows all weights are 0 and every score is the threshold; an empty table gives an empty result; further columns of the
documents are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, place, shared
from .textbuf import Buf, chunks, mix, twice, windows

NAMES = ["log_words", "word_length", "upper", "digit", "symbol", "bar", "bang", "stop", "comma", "high_byte", "distinct", "repeat3", "repeat_line", "words_a_line", "capital_start", "empty"]
GRAMS = 64
WIDTH = len(NAMES) + 2 * GRAMS
#: Scale of the hashed shares, which holds their weights down; the best of 1, 0.3 and 0.1 on folds of the training rows.
GRAM_SCALE = 0.3
_SCALE = np.array([1.0] * len(NAMES) + [GRAM_SCALE] * (2 * GRAMS))


def _in(chars: bytes) -> np.ndarray:
    x = np.zeros(256, bool)
    x[list(chars)] = True
    return x


_SETS = {"digit": _in(b"0123456789"), "symbol": _in(b"#*$%&<>@=~^_{}[]"), "bar": _in(b"|"), "bang": _in(b"!?"), "stop": _in(b"."), "comma": _in(b",;:")}
_UPPER = _in(bytes(range(65, 91)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = _in(bytes(range(65, 91)) + bytes(range(97, 123)))


def features(buf: Buf) -> np.ndarray:
    """One row of WIDTH numbers for each text: those of NAMES, and shares of hashed words and of hashed strings of 3 bytes (A-Z lower-cased)."""
    s, e, doc = buf.words()
    n, data = buf.n, buf.data
    per = lambda x, w=None: np.bincount(x, weights=w, minlength=n).astype(float)
    words, size = per(doc), np.diff(buf.off).astype(float)
    w, b = np.maximum(words, 1), np.maximum(size, 1)
    x = {"log_words": np.log1p(words), "word_length": np.minimum(per(doc, e - s) / w, 30)}
    letters = buf.per_doc(_LETTER[data])
    x["upper"] = buf.per_doc(_UPPER[data]) / np.maximum(letters, 1)
    for k, table in _SETS.items():
        x[k] = buf.per_doc(table[data]) / w
    x["high_byte"] = buf.per_doc(data >= 128) / b
    h = buf.hashes(s, e)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64) | np.uint64(1 << 63))  # never the hash of a word, else two short words in two texts can take each other's place
    key = np.sort(h ^ salt[doc]) if len(s) else h
    _, at = np.unique(h ^ salt[doc], return_index=True)
    x["distinct"] = per(doc[at]) / np.sqrt(w)
    t, at = windows(h, doc, 3)
    x["repeat3"] = per(doc[at[twice(t ^ salt[doc[at]])]]) / w if len(at) else np.zeros(n)
    ls, le, ld = buf.lines()
    keep = le > ls
    ls, le, ld = ls[keep], le[keep], ld[keep]
    key = buf.hashes(ls, le) ^ salt[ld] if len(ls) else np.zeros(0, np.uint64)
    lines = np.maximum(per(ld), 1)
    x["repeat_line"] = per(ld[twice(key)]) / lines
    x["words_a_line"] = np.log1p(words / lines)
    x["capital_start"] = per(doc[_UPPER[data[s]]]) / w if len(s) else np.zeros(n)
    x["empty"] = (words == 0).astype(float)
    word = (buf.hashes(s, e, lower=True) >> np.uint64(58)).astype(np.int64)
    low = _LOWER[data].astype(np.uint32)
    three = (low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]) * np.uint32(0x9E3779B1) >> np.uint32(26)
    of = np.repeat(np.arange(n), np.diff(buf.off))
    inside = of[:-2] == of[2:]
    shares = [np.bincount(d * GRAMS + k, minlength=n * GRAMS).reshape(n, GRAMS) / m[:, None] for d, k, m in ((doc, word, w), (of[:-2][inside], three[inside].astype(np.int64), b))]
    return np.column_stack([*(x[k] for k in NAMES), *shares])


#: Distance of the nodes at which utilities are counted for the gradient, and for the second derivatives.
FINE, COARSE = 0.1, 0.5
#: Training rows in a block; blocks in a task, and tasks at most (each sends its sums, under a MB, to the driver).
BLOCK_ROWS, BLOCKS_A_TASK, MOST_TASKS = 2000, 4, 128


def _fine(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six nodes around each utility and their Lagrange weights."""
    at = np.floor(u / FINE)
    t, near = u / FINE - at, np.arange(-2, 4)
    w = np.ones((len(u), 6))
    for k, a in enumerate(near):
        for b in near[near != a]:
            w[:, k] *= (t - b) / (a - b)
    return at.astype(np.int64)[:, None] + near, w


def _coarse(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two nodes around each utility and their linear weights."""
    at = np.floor(u / COARSE)
    t = u / COARSE - at
    return at.astype(np.int64)[:, None] + np.arange(2), np.stack([1 - t, t], 1)


def _whole(x: np.ndarray, n: int) -> np.ndarray:
    """x in fixed point; sums over n rows, of at most 100 each, stay below 2**62."""
    return np.rint(x * _unit(n)).astype(np.int64)


def _unit(n: int) -> float:
    return 2.0 ** (62 - int(np.ceil(np.log2(100 * n))))


def _onto(total: tuple[int, np.ndarray] | None, lo: int, x: np.ndarray) -> tuple[int, np.ndarray]:
    """Sum of two stretches of a grid, each with the number of its first node."""
    if total is None:
        return lo, x
    first, last = min(lo, total[0]), max(lo + len(x), total[0] + len(total[1]))
    out = np.zeros((last - first, *x.shape[1:]), np.int64)
    for k, y in (total, (lo, x)):
        out[k - first : k - first + len(y)] += y
    return first, out


def counted(y: np.ndarray, z: np.ndarray, w: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """The fine and the coarse grid with the rows of label 0 and of label 1 that are at each node."""
    u, out = utility(z, w), []
    for nodes in (_fine, _coarse):
        at, share = nodes(u)
        lo, size = int(at.min()), int(at.max() - at.min()) + 1
        out.append((lo, _whole(np.stack([np.bincount((at[y == c] - lo).ravel(), share[y == c].ravel(), size) for c in (0, 1)], 1), n)))
    return out


def derived(y: np.ndarray, z: np.ndarray, w: np.ndarray, n: int, fine: tuple, coarse: tuple) -> np.ndarray:
    """For each label the sums over its rows of features and of their products, weighted by the opponents, and of features at each coarse node; in a row."""
    u, out = utility(z, w), []
    (at, share), (near, part) = _fine(u), _coarse(u)
    for c in (0, 1):
        m = y == c
        r = (fine[1][at[m] - fine[0], c] * share[m]).sum(1)
        k = (coarse[1][near[m] - coarse[0], c] * part[m]).sum(1)
        hat = np.zeros((int(m.sum()), len(coarse[1])))
        hat[np.arange(len(hat))[:, None], near[m] - coarse[0]] = part[m]
        out += [r @ z[m], ((z[m] * k[:, None]).T @ z[m]).ravel(), (hat.T @ z[m]).ravel()]
    return _whole(np.concatenate(out), n)


def utility(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (z * w).sum(1)  # row by row, so equal rows get equal sums


def _opponents(grid: tuple[int, np.ndarray], step: float, kernel: Callable, sizes: tuple[float, float]) -> tuple[int, np.ndarray]:
    """At each node the mean of kernel(utility of label 0 - utility of label 1) over the rows of the other label."""
    lo, x = grid
    d = kernel(np.arange(1 - len(x), len(x)) * step)
    mid = slice(len(x) - 1, 2 * len(x) - 1)
    return lo, np.stack([np.convolve(x[:, 1] / sizes[1], d)[mid], np.convolve(x[:, 0] / sizes[0], d[::-1])[mid]], 1)


def _logistic(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -700, 700)))


def _slope(t: np.ndarray) -> np.ndarray:
    return _logistic(t) * _logistic(-t)


def minimise(width: int, bad: int, good: int, count: Callable, derive: Callable, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-w (x_i - x_j))) over all pairs i of label 1, j of label 0, plus l2 |w|^2 / 2, by Newton steps.

    count(w) and derive(w, fine, coarse) give the sums of counted() and derived() over all rows.
    """
    w = np.zeros(width)
    if not good or not bad:
        return w
    unit, sizes = _unit(good + bad), (float(bad), float(good))
    for _ in range(rounds):
        fine, coarse = ((lo, x / unit) for lo, x in count(w))
        sums = derive(w, _opponents(fine, FINE, _logistic, sizes), _opponents(coarse, COARSE, _slope, sizes)) / unit
        (g0, s0, m0), (g1, s1, m1) = (np.split(x, [width, width + width**2]) for x in np.split(sums, 2))
        nodes = np.arange(len(coarse[1])) * COARSE
        cross = m1.reshape(-1, width).T / good @ _slope(nodes - nodes[:, None]) @ m0.reshape(-1, width) / bad
        hess = (s0 / bad + s1 / good).reshape(width, width) - cross - cross.T + l2 * np.eye(width)
        step = np.linalg.solve(hess, g0 / bad - g1 / good + l2 * w)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def bradley_terry(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """minimise() for rows in memory, with scaled features x."""
    n = len(y)
    return minimise(x.shape[1], int((y == 0).sum()), int((y == 1).sum()), lambda w: counted(y, x, w, n), lambda w, *grids: derived(y, x, w, n, *grids), l2)


class Ranker:
    """Means, weights, cut and scale; score() maps features to (0, 1)."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, threshold: float = 0.3):
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w, self.cut, self.spread = np.zeros(len(mean)), 0.0, 1.0
        self.shift = float(np.log(threshold / (1 - threshold)))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8) * _SCALE

    def score(self, x: np.ndarray) -> np.ndarray:
        t = np.clip((utility(self.scaled(x), self.w) - self.cut) / self.spread, -30, 30)
        return 1 / (1 + np.exp(-t - self.shift))


def _rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, WIDTH).astype(float)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: one row for each block."""
    now, ys, xs = None, [], []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.array(ys, np.uint8).tobytes()], pa.binary()), pa.array([b"".join(xs)], pa.binary())], names=["block", "y", "x"])

    for batch in batches:
        for block, y, x in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
            if block != now:
                if ys:
                    yield out()
                now, ys, xs = block, [], []
            ys.append(y)
            xs.append(x)
    if ys:
        yield out()


def _told(blocks: DataFrame, f: Callable) -> list:
    """What f makes of the blocks (number, labels, features) of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, np.frombuffer(y, np.uint8), np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(float)) for batch in batches for k, y, x in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True))
        out = f(rows)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], names=["told"])

    return [pickle.loads(x) for x in blocks.mapInArrow(run, "told binary").toArrow()["told"].to_pylist()]


def _moments(rows: Iterator[tuple]) -> list[tuple] | None:
    return [(k, len(y), int(y.sum()), x.mean(0), ((x - x.mean(0)) ** 2).sum(0)) for k, y, x in rows] or None


def order_statistics(ranks: list[int], bins: Callable) -> list[float]:
    """The values of these ranks (from 0). bins(k, heads) gives, for keys (as of sortable()) with the first k times 16 bits in heads, a dict of counts by the first k + 1 times 16 bits."""
    heads, left = [0] * len(ranks), list(ranks)
    for k in range(4):
        found = sorted(bins(k, set(heads)).items())
        for j, head in enumerate(heads):
            for x, c in found:
                if x >> 16 == head:
                    if left[j] < c:
                        heads[j] = x
                        break
                    left[j] -= c
    keys = np.array(heads, np.uint64)
    top = np.uint64(1 << 63)
    return np.where(keys >= top, keys ^ top, ~keys).view(np.float64).tolist()


def sortable(u: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of u."""
    x = (u + 0.0).view(np.uint64)
    return np.where(x >> np.uint64(63) > 0, ~x, x | np.uint64(1 << 63))


def key_bins(u: np.ndarray, k: int, heads: set[int]) -> dict[int, int]:
    key = sortable(u) >> np.uint64(48 - 16 * k)
    if k:
        key = key[np.isin(key >> np.uint64(16), np.array(sorted(heads), np.uint64))]
    return dict(zip(*(x.tolist() for x in np.unique(key, return_counts=True)), strict=True))


def train(blocks: DataFrame, threshold: float = 0.3) -> Ranker:
    """The ranker learned from all rows of blocks (block, y, x)."""
    n, good, mean, square = 0, 0, np.zeros(WIDTH), np.zeros(WIDTH)
    for _, c, g, m, s in sorted((x for told in _told(blocks, _moments) for x in told), key=lambda x: x[0]):
        square += s + (m - mean) ** 2 * (n * c / (n + c))
        mean = mean + (m - mean) * (c / (n + c))
        n, good = n + c, good + g
    model = Ranker(mean, np.sqrt(square / max(n, 1)), threshold)

    def count(w):
        def run(rows):
            total = [None, None]
            for _, y, x in rows:
                total = [_onto(t, *g) for t, g in zip(total, counted(y, model.scaled(x), w, n), strict=True)]
            return None if total[0] is None else total

        total = [None, None]
        for told in _told(blocks, run):
            total = [_onto(t, *g) for t, g in zip(total, told, strict=True)]
        return total

    def derive(w, *grids):
        return sum(_told(blocks, lambda rows: sum(derived(y, model.scaled(x), w, n, *grids) for _, y, x in rows)))

    w = minimise(WIDTH, n - good, good, count, derive)
    if not w.any():
        return model

    def bins(k, heads):
        def run(rows):
            out: dict[int, int] = {}
            for _, _, x in rows:
                for key, c in key_bins(utility(model.scaled(x), w), k, heads).items():
                    out[key] = out.get(key, 0) + c
            return out

        out: dict[int, int] = {}
        for told in _told(blocks, run):
            for key, c in told.items():
                out[key] = out.get(key, 0) + c
        return out

    def spread(rows):
        return [(k, len(u), float(u.mean()), float(((u - u.mean()) ** 2).sum())) for k, u in ((k, utility(model.scaled(x), w)) for k, _, x in rows)] or None

    at = (n - 1) * (1 - good / n)
    low, high = order_statistics([int(at), min(int(at) + 1, n - 1)], bins)
    n, m, s = 0, 0.0, 0.0
    for _, c, m2, s2 in sorted(x for told in _told(blocks, spread) for x in told):
        s += s2 + (m2 - m) ** 2 * (n * c / (n + c))
        m += (m2 - m) * (c / (n + c))
        n += c
    model.w, model.cut, model.spread = w, low + (high - low) * (at - int(at)), max((s / n) ** 0.5, 1e-6) / 2
    return model


def quality_ranking(docs: DataFrame, labels: DataFrame, held_mod: int = 5, held_rest: int = 0, threshold: float = 0.3, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """key, held_out, score and predicted of every row of docs."""
    spark = docs.sparkSession
    kind = dict(docs.select(key).dtypes)[key]
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_mod(key, held_mod) != held_rest)).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf in chunks(batch.column(2)):
                x = features(buf).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["_uid", key, "_x"])

    described = shared(place(docs.select(key, text)).select("_uid", key, text).mapInArrow(describe, f"_uid long, {key} {kind}, _x binary"), spark)
    # a row for each label, also where an id repeats
    rows = described.where(crc_mod(key, held_mod) != held_rest).join(known, key).groupBy(key).agg(F.min(F.struct("_uid", "_y", "_x")).alias("r")).select("r.*")
    rows = shared(rows, spark)
    n = -(-rows.count() // BLOCK_ROWS)
    dealt = rows.select(F.pmod(F.xxhash64("_uid"), F.lit(max(n, 1))).cast("int").alias("block"), F.col("_y").alias("y"), F.col("_x").alias("x"), "_uid")
    blocks = shared(dealt.repartition(max(n, 1), "block").sortWithinPartitions("block", "_uid").select("block", "y", "x").mapInArrow(_pack, "block int, y binary, x binary"), spark)
    model = train(blocks.coalesce(min(-(-max(n, 1) // BLOCKS_A_TASK), MOST_TASKS)), threshold)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(_rows(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[key, "score", "predicted"])

    out = described.select(key, "_x").mapInArrow(score, f"{key} {kind}, score double, predicted int")
    return out.select(key, (crc_mod(key, held_mod) == held_rest).alias("held_out"), "score", "predicted")
