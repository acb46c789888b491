"""Command line: demo, run and report."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from earshot.functions.text import NormalizerConfig
from earshot.plans.planner import BudgetExceeded, run_benchmark
from earshot.plans.report import build_report
from earshot.sources.audio import plain_path, read_audio
from earshot.sources.manifest import read_manifest, read_results, select_conditions, write_results
from earshot.sources.samples import SENTENCES, sample_corpus, write_corpus


def _session() -> SparkSession:
    return SparkSession.builder.appName("earshot").config("spark.speculation", "false").getOrCreate()


def _conditions(names: list[str] | None):
    """The conditions asked for; ends with a message and code 2 where one is unknown."""
    try:
        return select_conditions(names)
    except ValueError as e:
        print(e, file=sys.stderr)
        raise SystemExit(2) from None


def _finish(results, plan: dict, out: str, report: bool, normalizer: NormalizerConfig) -> int:
    path = write_results(results, plan, out)
    if plan.get("skipped_utterances"):
        print(f"utterances without readable audio: {plan['skipped_utterances']}", file=sys.stderr)
    if plan.get("stopped_early"):
        print(f"ended at the budget, after ${plan['actual_cost_usd']:.2f}", file=sys.stderr)
    print(f"results: {path}")
    if report:
        print(f"report: {build_report(read_results(results.sparkSession, path)[1], plan, out, normalizer)['markdown']}")
    return 0


def demo(a: argparse.Namespace) -> int:
    results, plan = run_benchmark(sample_corpus(_session(), a.n), ["mock"], _conditions(a.conditions), max_cost_usd=a.max_cost)
    return _finish(results, plan, a.out, True, NormalizerConfig())


def load(spark: SparkSession, path: str):
    """Utterances of a manifest with their audio, by path; those without readable audio have null."""
    utts = read_manifest(spark, path)
    folders = [r["d"] for r in utts.select(F.regexp_replace("audio_path", "/[^/]*$", "").alias("d")).distinct().collect()]  # folders of a listing
    audio = read_audio(spark, folders[0]) if folders else None
    for d in folders[1:]:
        audio = audio.unionByName(read_audio(spark, d))
    joined = utts.join(audio.withColumnRenamed("duration_s", "_seconds"), plain_path(F.col("audio_path")) == F.col("path"), "left")
    return joined.withColumn("duration_s", F.when(F.col("duration_s") > 0, F.col("duration_s")).otherwise(F.coalesce("_seconds", F.lit(0.0)))).drop("path", "_seconds")


def run(a: argparse.Namespace) -> int:
    normalizer = NormalizerConfig(strip_filler=a.strip_filler)
    try:
        results, plan = run_benchmark(load(_session(), a.manifest), a.providers, _conditions(a.conditions), normalizer, a.max_cost, a.dry_run, save_to=f"{a.out}/transcripts")
    except BudgetExceeded as e:
        print(f"not started: {e}", file=sys.stderr)
        return 2
    if a.dry_run:
        print(json.dumps(plan, indent=2))
        return 0
    return _finish(results, plan, a.out, not a.no_report, normalizer)


def report(a: argparse.Namespace) -> int:
    plan, rows = read_results(_session(), a.results)
    print(build_report(rows, plan, a.out or os.path.dirname(os.path.abspath(a.results)), NormalizerConfig(strip_filler=a.strip_filler))["markdown"])
    return 0


def corpus(a: argparse.Namespace) -> int:
    """Writes the synthetic corpus; a folder that has a manifest is left as it is."""
    print(f"manifest: {write_corpus(_session(), a.out, a.n)}")
    return 0


def spoken_corpus(a: argparse.Namespace) -> int:
    """Speech from a text-to-speech program of the system isn't supported; code 3 as where none is installed."""
    print(f"no text-to-speech backend; the {sum(map(len, SENTENCES.values()))} sentences are in earshot.sources.samples", file=sys.stderr)
    return 3


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="earshot", description="Measures speech recognition on telephone-grade audio.")
    sub = p.add_subparsers(required=True)
    d = sub.add_parser("demo", help="synthetic corpus and mock recogniser, offline")
    d.add_argument("--out", default="out/demo")
    d.add_argument("--n", type=int, default=3)
    d.add_argument("--conditions", nargs="*")
    d.add_argument("--max-cost", type=float, default=0.0)
    d.set_defaults(do=demo)
    r = sub.add_parser("run", help="run over a manifest")
    r.add_argument("--manifest", required=True)
    r.add_argument("--providers", nargs="+", required=True)
    r.add_argument("--conditions", nargs="*")
    r.add_argument("--out", default="out")
    r.add_argument("--max-cost", type=float, default=1.0)
    r.add_argument("--dry-run", action="store_true")
    r.add_argument("--strip-filler", action="store_true")
    r.add_argument("--no-report", action="store_true")
    r.set_defaults(do=run)
    t = sub.add_parser("report", help="rebuild a report from stored results")
    t.add_argument("--results", required=True)
    t.add_argument("--out")
    t.add_argument("--strip-filler", action="store_true")
    t.set_defaults(do=report)
    c = sub.add_parser("corpus", help="write the synthetic corpus as WAV files with a manifest")
    c.add_argument("--out", required=True)
    c.add_argument("--n", type=int, default=3)
    c.set_defaults(do=corpus)
    sub.add_parser("tts-corpus", help="spoken corpus; needs a text-to-speech backend, and there is none").set_defaults(do=spoken_corpus)
    a, rest = p.parse_known_args(argv)
    if rest and a.do is not spoken_corpus:
        p.error(f"unknown arguments: {' '.join(rest)}")
    return a.do(a)


if __name__ == "__main__":
    raise SystemExit(main())
