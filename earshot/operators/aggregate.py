"""Pooled error rates and the tables of a report, as grouped aggregations over scored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")
PARTS = ("substitutions", "deletions", "insertions")
DIMENSIONS = ("accent", "age_band", "domain", "sex")


def rate(errors: Column, reference: Column) -> Column:
    """errors / reference; without reference words 0 if there are no errors, else infinity. Never clamped."""
    return F.when(reference == 0, F.when(errors == 0, F.lit(0.0)).otherwise(F.lit(INF))).otherwise(errors.cast("double") / F.when(reference != 0, reference))


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def pooled(rows: DataFrame, *by: str | Column) -> DataFrame:
    """Summed counts, errors and rate for each group: rates are pooled over words, never averaged."""
    x = rows.groupBy(*by).agg(*[_sum(c).alias(c) for c in (*PARTS, "reference_words")])
    x = x.withColumn("errors", sum((F.col(c) for c in PARTS[1:]), F.col(PARTS[0])))
    return x.withColumn("wer", rate(F.col("errors"), F.col("reference_words")))


def slices(rows: DataFrame, dims: tuple[str, ...] = (*DIMENSIONS, "condition")) -> DataFrame:
    """All one-dimensional slices by provider, and the provider's total, in one pass: dim, value, provider and pooled counts."""
    sets = [[F.col("provider"), F.col(d)] for d in dims] + [[F.col("provider")]]
    named = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims], F.lit("total"))
    value = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d)) for d in dims])
    x = rows.groupingSets(sets, "provider", *dims).agg(named.alias("dim"), value.alias("value"), *[_sum(c).alias(c) for c in (*PARTS, "reference_words")])
    x = x.select("dim", "value", "provider", *PARTS, "reference_words").withColumn("errors", sum((F.col(c) for c in PARTS[1:]), F.col(PARTS[0])))
    return x.withColumn("wer", rate(F.col("errors"), F.col("reference_words")))


def slice_pivot(rows: DataFrame, by: str, providers: list[str], min_words: int = 20) -> DataFrame:
    """A row for each value of by, a column for each provider: pooled wer, null below min_words; rows without any value are left out."""
    x = pooled(rows, by, "provider").withColumn("wer", F.when(F.col("reference_words") >= min_words, F.col("wer")))
    x = x.groupBy(by).pivot("provider", providers).agg(F.first("wer"))
    return x.where(F.coalesce(*[F.col(f"`{p}`") for p in providers]).isNotNull())


def exact_upper_median(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """by and median_{value}: the element at half the length of a group's sorted finite values, 0.0 where it has none.

    By ranks, for groups of any size: counts by value, then a running sum over the distinct values.
    """
    from pyspark.sql import Window

    finite = F.when(F.col(value) != F.lit(INF), F.col(value))
    counts = rows.select(*by, finite.alias(value)).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col(value).isNotNull(), F.col("n")).otherwise(0))
    upto = Window.partitionBy(*by).orderBy(value)  # a group's nulls come first, with no weight
    ranked = counts.select(*by, value, F.sum("n").over(upto).alias("to"), F.sum("n").over(Window.partitionBy(*by)).alias("all"), "n")
    half = F.floor(F.col("all") / 2)
    middle = F.when((F.col("to") > half) & (F.col("to") - F.col("n") <= half), F.col(value))
    return ranked.groupBy(*by).agg(F.coalesce(F.max(middle), F.lit(0.0)).alias(f"median_{value}"))


def headline(rows: DataFrame, baseline: str = "wideband_clean", channel: str = "telephony_clean") -> DataFrame:
    """For each provider: wer of the baseline and of the channel (null without words), their ratio, and the median real-time factor."""
    err = sum((F.col(c) for c in PARTS[1:]), F.col(PARTS[0]))
    cols = []
    for name, cond in (("base", baseline), ("tel", channel)):
        at = F.col("condition") == cond
        cols += [F.coalesce(F.sum(F.when(at, err)), F.lit(0)).alias(f"{name}_errors"), F.coalesce(F.sum(F.when(at, F.col("reference_words"))), F.lit(0)).alias(f"{name}_words")]
    x = rows.groupBy("provider").agg(*cols)
    for name in ("base", "tel"):
        x = x.withColumn(f"{name}_wer", F.when(F.col(f"{name}_words") > 0, rate(F.col(f"{name}_errors"), F.col(f"{name}_words"))))
    x = x.withColumn("degradation", F.when((F.col("base_wer") > 0) & F.col("tel_wer").isNotNull(), F.col("tel_wer") / F.when(F.col("base_wer") > 0, F.col("base_wer"))))
    med = exact_upper_median(rows, "rtf", "provider")
    return x.join(med, "provider", "left").select("provider", "base_wer", "tel_wer", "degradation", F.coalesce("median_rtf", F.lit(0.0)).alias("median_rtf"))


def failure_mode(rows: DataFrame) -> DataFrame:
    """Counts of each provider and what prevails; of equal counts substitutions come first, then deletions."""
    s, d, i = (F.col(c) for c in PARTS)
    return pooled(rows, "provider").select("provider", *PARTS, F.when((s >= d) & (s >= i), "mishears").when(d >= i, "drops audio").otherwise("hallucinates").alias("read"))


def error_histogram(rows: DataFrame, order: str, width: int = 110) -> DataFrame:
    """provider, error (its first characters) and n, the most frequent first, of equal ones the earliest; order: a column that numbers the rows."""
    bad = rows.where(F.col("error").isNotNull() & (F.col("error") != ""))
    x = bad.groupBy("provider", F.substring("error", 1, width).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_ord"))
    return x.orderBy(F.desc("n"), "first_ord")


def heat_cells(rows: DataFrame) -> DataFrame:
    """condition, provider, wer (null without words) and the cell's colour: green over amber to red on 0 to 60 %, grey without a finite rate."""
    x = pooled(rows, "condition", "provider").withColumn("wer", F.when(F.col("reference_words") > 0, F.col("wer")))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("wer") / 0.60))
    low, high = t / 0.5, (t - 0.5) / 0.5
    green, amber, red = (21, 128, 61), (217, 165, 74), (185, 28, 28)
    part = [F.when(t < 0.5, F.lit(g) + low * (a - g)).otherwise(F.lit(a) + high * (r - a)).cast("int").cast("string") for g, a, r in zip(green, amber, red, strict=True)]
    shade = F.concat(F.lit("rgb("), part[0], F.lit(","), part[1], F.lit(","), part[2], F.lit(")"))
    return x.select("condition", "provider", "wer", F.when(F.col("wer").isNull() | F.isnan("wer") | (F.col("wer") == INF), "#6b7280").otherwise(shade).alias("colour"))


def distinct_values(rows: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """The number of values of each dimension, one row."""
    return rows.agg(*[F.count_distinct(d).alias(d) for d in dims])
