"""Planning and running a benchmark: the grid of cells, costs and the budget, degradation, transcription, scoring."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.functions.dsp import CONFIG_SCHEMA, ChannelConfig, degrade, standard_conditions
from earshot.functions.signal import real_time_factor
from earshot.functions.text import NormalizerConfig
from earshot.operators.align import score
from earshot.providers import PRICES_LAST_CHECKED, REGISTRY, providers_table
from earshot.sources.manifest import conditions_table
from earshot.sources.store import shared, shared_folder


class BudgetExceeded(RuntimeError):
    """The projected cost is above the budget; nothing was sent."""


def plan_grid(utterances: DataFrame, conditions: DataFrame, providers: DataFrame) -> DataFrame:
    """Every cell: utterances by conditions by providers; the two small sides are lists of parameters."""
    return utterances.crossJoin(F.broadcast(conditions)).crossJoin(F.broadcast(providers))


def cost_rollup(utterances: DataFrame, providers: DataFrame, n_conditions: int) -> DataFrame:
    """provider (TOTAL for all) and usd: price by seconds by conditions."""
    seconds = utterances.agg(F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("seconds"))
    usd = F.sum(F.col("usd_per_hour") * F.col("seconds") * n_conditions / 3600.0)
    x = providers.crossJoin(F.broadcast(seconds)).rollup("provider").agg(F.coalesce(usd, F.lit(0.0)).alias("usd"), F.grouping("provider").alias("g"))
    return x.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("provider")).alias("provider"), "usd")


_RANGES = 4096


def budget_cut(cells: DataFrame, max_cost: float, order: list[str], cost: str = "cost_usd") -> DataFrame:
    """The cells up to and with the one whose running cost passes the budget; 0 means no limit.

    The running sum is made in two steps, so that no task holds all cells: the first column of the order (a number) is
    cut in 4096 ranges of equal width, their sums are added up in one task, and each range is summed in a task of its own.
    Costs are added as decimals, so that the order of additions doesn't matter.
    """
    if max_cost <= 0:
        return cells
    first, exact = F.col(order[0]).cast("double"), F.col(cost).cast("decimal(28,12)")
    ends = cells.agg(F.min(first).alias("_low"), F.max(first).alias("_high"))
    place = F.least(F.floor((first - F.col("_low")) * _RANGES / (F.col("_high") - F.col("_low") + 1)), F.lit(_RANGES - 1)).cast("int")
    dealt = cells.crossJoin(F.broadcast(ends)).withColumn("_range", place).drop("_low", "_high")
    sums = dealt.groupBy("_range").agg(F.sum(exact).alias("_sum"))  # 4096 rows at most
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sums.select("_range", (F.sum("_sum").over(upto) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.col("_before") + F.sum(exact).over(inside)
    return dealt.join(F.broadcast(before), "_range").withColumn("_running", running).where(F.col("_running") - exact <= max_cost).drop("_range", "_before", "_running")


def make_plan(utterances: DataFrame, providers: list[str], conditions: list[ChannelConfig], normalizer: NormalizerConfig) -> dict:
    spark = utterances.sparkSession
    row = utterances.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("s")).first()
    usd = {r["provider"]: r["usd"] for r in cost_rollup(utterances, providers_table(spark, providers), len(conditions)).collect()}
    return {
        "utterances": row["n"], "conditions": [c.name for c in conditions], "providers": list(providers), "cells": row["n"] * len(conditions) * len(providers),
        "audio_seconds": round(row["s"], 1), "estimated_cost_usd": {p: round(usd[p], 4) for p in [*dict.fromkeys(providers), "TOTAL"]}, "prices_last_checked": PRICES_LAST_CHECKED, "normalizer": normalizer.describe(),
    }


CELL = "id string, utt_ord int, cond_ord int, prov_ord int, provider string, condition string, hypothesis string, latency_s double, audio_s double, cost_usd double, error string"


def transcribe(degraded: DataFrame, providers: list[str], provider_kwargs: dict | None = None) -> DataFrame:
    """A row for each degraded signal and provider, or for those in the column ask (an array of names) if there is one. Providers are made once in each task."""
    kwargs = provider_kwargs or {}
    for p in providers:
        if p not in REGISTRY:
            raise KeyError(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [REGISTRY[p](**kwargs.get(p, {})) for p in providers]
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                audio = np.asarray(r.audio, np.float32)
                for k, (name, prov) in enumerate(zip(providers, made, strict=True)):
                    if name not in r.ask:
                        continue
                    t = prov.transcribe(audio, int(r.sr), reference=r.reference or "", key=f"{r.id}/{r.condition}")
                    rows.append((r.id, r.utt_ord, r.cond_ord, k, name, r.condition, t.text, t.latency_s, t.audio_s, t.cost_usd, t.error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELL.split(", ")])

    ask = F.col("ask") if "ask" in degraded.columns else F.array(*map(F.lit, providers))
    return degraded.select("utt_ord", "cond_ord", "id", "condition", "reference", "audio", "sr", ask.alias("ask")).mapInPandas(run, CELL)


def stored_cells(spark: SparkSession, folder: str | None) -> DataFrame | None:
    """Transcripts of earlier runs in the folder that came without an error."""
    if not folder:
        return None
    try:
        return spark.read.parquet(folder).where(F.col("error").isNull()).select(*(c.split()[0] for c in CELL.split(", ")))
    except AnalysisException:  # there is none yet
        return None


def run_benchmark(utterances: DataFrame, providers: list[str], conditions: list[ChannelConfig] | None = None, normalizer: NormalizerConfig = NormalizerConfig(), max_cost_usd: float = 0.0, dry_run: bool = False, provider_kwargs: dict | None = None, batch: int = 200, save_to: str | None = None) -> tuple[DataFrame | None, dict]:
    """Results (a row for each cell) and the plan.

    utterances: utt_ord, the fields of an utterance, audio and sr (null audio is skipped and counted in the plan). A signal is
    degraded once and shared by all providers. Where calls cost money the degraded signals are written once, dealt to
    batches, and each batch's transcripts are written before the next starts (in save_to, or in the shared
    folder), so no retry of a later step repeats a call. A run with the save_to of an earlier one asks only for cells that are not
    stored there. The budget stops a run within the batch that passes it: results end at the cell that does,
    actual_cost_usd tells what all cells of this run cost, and stored transcripts of the others are used by the next run.
    """
    spark: SparkSession = utterances.sparkSession
    conditions = conditions or standard_conditions()
    if utterances.isEmpty():
        raise ValueError("there are no utterances to run")
    plan = make_plan(utterances, providers, conditions, normalizer)
    if dry_run:
        return None, plan
    total = plan["estimated_cost_usd"]["TOTAL"]
    if total > max_cost_usd:
        raise BudgetExceeded(f"the plan costs ${total:.2f}, the budget is ${max_cost_usd:.2f}; no call was made")
    began = time.time()
    config = F.struct(*[c.split()[0] for c in CONFIG_SCHEMA.split(", ")])
    table = conditions_table(spark, conditions).select("cond_ord", F.col("name").alias("condition"), config.alias("config"))
    audible = utterances.where(F.col("audio").isNotNull())
    degraded = audible.crossJoin(F.broadcast(table)).withColumn("_d", degrade(F.col("audio"), F.col("sr"), F.col("config"))).select("utt_ord", "cond_ord", "id", "condition", "reference", F.col("_d.audio").alias("audio"), F.col("_d.sr").alias("sr"))
    metered = total > 0
    done = stored_cells(spark, save_to)
    if done is not None:  # what is stored is not asked for again
        done = shared(done.where(F.col("provider").isin(providers)).dropDuplicates(["id", "condition", "provider"]), spark)
        known = done.groupBy("id", "condition").agg(F.collect_set("provider").alias("known"))  # at most one of each provider
        asked = F.array_except(F.array(*map(F.lit, providers)), F.coalesce("known", F.array().cast("array<string>")))
        degraded = degraded.join(known, ["id", "condition"], "left").withColumn("ask", asked).drop("known").where(F.size("ask") > 0)
    steps: list[DataFrame] = [degraded]
    if metered:
        folder = shared_folder(spark, "signals")
        dealt = degraded.withColumn("batch", F.floor(F.col("utt_ord") / batch).cast("int"))
        dealt.write.partitionBy("batch").parquet(folder)
        signals = spark.read.schema(dealt.schema).parquet(folder)
        steps = [signals.where(F.col("batch") == r["batch"]) for r in signals.select("batch").distinct().orderBy("batch").collect()]  # a row for each batch
    parts, spent, run_id = [], 0.0, uuid.uuid4().hex
    for k, some in enumerate(steps):
        cells = transcribe(some, providers, provider_kwargs)
        if save_to:
            cells.write.parquet(f"{save_to}/run={run_id}/batch={k}")
            cells = spark.read.parquet(f"{save_to}/run={run_id}/batch={k}")
        else:
            cells = shared(cells, spark)
        parts.append(cells)
        spent += cells.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).first()[0]
        if spent > max_cost_usd > 0:
            plan["stopped_early"] = True
            break
    cells = spark.createDataFrame([], CELL)
    for p in parts:
        cells = cells.unionByName(p)
    plan["actual_cost_usd"] = round(spent, 4)
    if plan.get("stopped_early"):
        cells = budget_cut(cells, max_cost_usd, ["utt_ord", "cond_ord", "prov_ord"])
        plan["cost_of_results_usd"] = round(cells.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).first()[0], 4)
    if done is not None:  # numbers may have changed since
        number = F.expr("array_position(array(" + ", ".join(f"'{p}'" for p in providers) + "), provider)").cast("int") - 1
        old = done.drop("utt_ord", "cond_ord").join(utterances.select("id", F.col("utt_ord").cast("int").alias("utt_ord")), "id").join(F.broadcast(table.select("cond_ord", "condition")), "condition")
        cells = cells.unionByName(old.withColumn("prov_ord", number))
    if not plan.get("stopped_early"):
        plan["skipped_utterances"] = plan["utterances"] - cells.agg(F.count_distinct("utt_ord")).first()[0]
    who = utterances.select("utt_ord", F.col("id").alias("utterance_id"), "reference", "accent", "age_band", "sex", "domain")
    x = cells.drop("id").join(who, "utt_ord").withColumn("rtf", F.round(real_time_factor(F.col("latency_s"), F.col("audio_s")), 4)).withColumn("latency_s", F.round("latency_s", 4))
    ord_ = (F.col("utt_ord").cast("long") * len(conditions) + F.col("cond_ord")) * len(providers) + F.col("prov_ord")
    results = score(x.withColumn("ord", ord_).drop("utt_ord", "cond_ord", "prov_ord", "audio_s"), normalizer)
    if not plan.get("stopped_early"):
        plan["wall_seconds"] = round(time.time() - began, 1)
    return results, plan
