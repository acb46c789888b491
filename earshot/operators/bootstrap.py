"""Percentile confidence intervals of pooled rates by resampling utterances.

Native: draws come from integer arithmetic on (resample, place), so they need no state, agree between engines and
partitionings, and the whole runs in the JVM. Counts of a cell are packed in an array in the order of
utterances, resamples are dealt out, and each looks its draws up by place.

Exact: the draws of Python's Mersenne Twister, a pandas group for each cell, which holds two numbers for each of the cell's
utterances and a bounded number of draws at a time.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.text import NormalizerConfig

from .aggregate import rate
from .align import score

_P = 2147483647


def draw(b: Column, k: Column, n: Column) -> Column:
    """A well-mixed place in 0 to n - 1 for draw k of resample b; all products stay below 2^62."""
    x = (b * 1000003 + k * 7919 + 12345) % _P
    x = (x * 48271 + b) % _P
    x = (x * x + k) % _P
    x = (x * x + b) % _P
    return x % n


def bounds(resamples: int, confidence: float) -> tuple[int, int]:
    """0-based places of the lower and upper end among sorted rates."""
    return int((1 - confidence) / 2 * resamples), min(resamples - 1, int((1 + confidence) / 2 * resamples))


def bootstrap_native(rows: DataFrame, by: list[str], order: str, errors: str = "errors", reference: str = "reference_words", resamples: int = 1000, confidence: float = 0.95) -> DataFrame:
    """by, n, lo and hi. A cell's utterances are held in one array, as a resample draws from all of them; so cells should be of report size."""
    spark = rows.sparkSession
    cell = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(errors).cast("long").alias("e"), F.col(reference).cast("long").alias("r")))), lambda x: F.struct(x["e"], x["r"]))
    packed = rows.groupBy(*by).agg(cell.alias("_u")).withColumn("n", F.size("_u"))
    # a cell's array goes to a fixed number of tasks, each with some of the resamples; draws are exploded beside it and
    # summed again at once, all in generated code, so no draw is shuffled
    shares = min(32, resamples)
    dealt = packed.crossJoin(F.broadcast(spark.range(shares).withColumnRenamed("id", "_share"))).repartition(shares, *by, "_share")
    some = dealt.select(*by, "n", "_u", F.explode(F.sequence(F.col("_share"), F.lit(resamples - 1).cast("long"), F.lit(shares).cast("long"))).alias("_b"))
    drawn = some.select(*by, "n", "_b", "_u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("_k"))
    pick = F.element_at("_u", (draw(F.col("_b"), F.col("_k"), F.col("n").cast("long")) + 1).cast("int"))
    sums = drawn.groupBy(*by, "n", "_b").agg(F.sum(pick["e"]).alias("_e"), F.sum(pick["r"]).alias("_r"))
    sampled = sums.groupBy(*by, "n").agg(F.array_sort(F.collect_list(rate(F.col("_e"), F.col("_r")))).alias("_r"))
    lo, hi = bounds(resamples, confidence)
    return sampled.select(*by, "n", F.element_at("_r", lo + 1).alias("lo"), F.element_at("_r", hi + 1).alias("hi"))


_DRAWS = 4_000_000


def twister_draws(n: int, resamples: int, seed: int) -> Iterator[np.ndarray]:
    """What random.Random(seed).randrange(n) gives, a row for each resample, some rows at a time; made in bulk from the generator's raw words.

    A draw is the leading bits of a word, as many as n has, and is drawn again while it is n or more.
    """
    state = random.Random(seed).getstate()[1]
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    shift, over = np.uint64(32 - n.bit_length()), np.zeros(0, np.int32)
    step = max(1, _DRAWS // n)
    for lo in range(0, resamples, step):
        need = min(step, resamples - lo) * n
        got = [over]
        have = len(over)
        while have < need:
            x = words.random_raw(2 * (need - have) + 16) >> shift
            got.append(x[x < n].astype(np.int32))
            have += len(got[-1])
        x = np.concatenate(got)
        over = x[need:]
        yield x[:need].reshape(-1, n)


@lru_cache(2)
def _kept_draws(n: int, resamples: int, seed: int) -> list[np.ndarray]:
    return list(twister_draws(n, resamples, seed))


def percentile_interval(errors: np.ndarray, reference: np.ndarray, resamples: int = 1000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float]:
    """The interval of one cell by draws of a Mersenne Twister; (0, 0) without utterances."""
    n = len(errors)
    if not n:
        return 0.0, 0.0
    draws = _kept_draws if n * resamples <= _DRAWS else twister_draws  # cells of one size share small draws
    sums = [(np.asarray(errors)[x].sum(1), np.asarray(reference)[x].sum(1)) for x in draws(n, resamples, seed)]
    e, r = (np.concatenate([x[j] for x in sums]) for j in (0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        rates = np.sort(np.where(r == 0, np.where(e == 0, 0.0, np.inf), e / r))
    lo, hi = bounds(resamples, confidence)
    return float(rates[lo]), float(rates[hi])


def bootstrap_exact(rows: DataFrame, by: list[str], order: str, errors: str = "errors", reference: str = "reference_words", resamples: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """by, n, lo and hi with the draws of a Mersenne Twister, the same for all cells of a size."""
    types = dict(rows.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        lo, hi = percentile_interval(pdf[errors].to_numpy(), pdf[reference].to_numpy(), resamples, confidence, seed)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), len(pdf), lo, hi]], columns=[*by, "n", "lo", "hi"])

    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", n long, lo double, hi double"
    return rows.select(*by, order, errors, reference).groupBy(*by).applyInPandas(one, schema)


def bootstrap_ci(pairs: DataFrame | list[tuple[str, str]], cfg: NormalizerConfig = NormalizerConfig(), resamples: int = 1000, confidence: float = 0.95, seed: int = 0, order: str | None = None) -> DataFrame:
    """n, lo and hi of the pooled wer of all pairs, one row (0 and 0 without any); order: the column that numbers a table's pairs."""
    if not isinstance(pairs, DataFrame):
        pairs, order = SparkSession.active().createDataFrame([(k, *p) for k, p in enumerate(pairs)], "_ord long, reference string, hypothesis string"), "_ord"
    if order is None:
        raise ValueError("a table needs a column that numbers its pairs")
    rows = score(pairs, cfg).select(order, (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("errors"), "reference_words", F.lit(0).alias("_cell"))
    found = bootstrap_exact(rows, ["_cell"], order, resamples=resamples, confidence=confidence, seed=seed)
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("lo", "hi")))
