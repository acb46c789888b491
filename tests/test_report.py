"""Pooled rates, slices, intervals, planning, sources, the report and the stream."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions.text import NormalizerConfig
from earshot.operators import aggregate as agg
from earshot.operators.align import score
from earshot.operators.bootstrap import bootstrap_exact, bootstrap_native, percentile_interval
from earshot.plans.planner import BudgetExceeded, budget_cut, cost_rollup, run_benchmark
from earshot.plans.report import build_report, heatmap_svg, markdown_table, percent
from earshot.providers import DeepgramProvider, HttpProvider, MockProvider, Transcript, providers_table
from earshot.sources import manifest as m
from earshot.sources.audio import encode_wav, read_audio, read_wav, wav_bytes, wav_duration
from earshot.sources.samples import sample_corpus, sample_rows, voice_rows

COLS = "provider string, condition string, accent string, age_band string, domain string, sex string, substitutions long, deletions long, insertions long, reference_words long, rtf double, error string, ord long"


def facts(spark, rows):
    return spark.createDataFrame(rows, COLS)


def row(p="p", c="wideband_clean", s=0, d=0, i=0, n=10, rtf=0.5, error=None, ord=0, accent="x", age="a", domain="m", sex="f"):
    return (p, c, accent, age, domain, sex, s, d, i, n, rtf, error, ord)


def test_rates_are_pooled(spark):
    got = agg.pooled(facts(spark, [row(n=10), row(s=1, n=1)]), "provider").first()
    assert (got["reference_words"], got["errors"], got["wer"]) == (11, 1, pytest.approx(1 / 11))
    none = {r["provider"]: r["wer"] for r in agg.pooled(facts(spark, [row("a", n=0), row("b", i=3, n=0), row("c", i=10, n=1)]), "provider").collect()}
    assert none == {"a": 0.0, "b": math.inf, "c": 10.0}


def test_published_table(spark):
    """Per-condition errors over 149 words give the known percentages and totals."""
    errors = {"wideband_clean": 7, "telephony_clean": 7, "telephony_alaw": 7, "telephony_noisy_15db": 13, "telephony_noisy_5db": 48, "telephony_lossy_3pct": 8, "telephony_suppressed": 16}
    got = {r["condition"]: percent(r["wer"]) for r in agg.pooled(facts(spark, [row(c=c, s=e, n=149) for c, e in errors.items()]), "condition").collect()}
    assert list(map(got.get, errors)) == ["4.7", "4.7", "4.7", "8.7", "32.2", "5.4", "10.7"] and sum(errors.values()) == 106
    words = score(voice_rows(spark, ["a", "b", "c", "d"], 3).withColumn("hypothesis", F.col("reference"))).agg(F.sum("reference_words"), F.max("wer")).first()
    assert tuple(words) == (149, 0.0)


def test_slices_and_floor(spark):
    rows = facts(spark, [row("p", accent="x", s=2, n=30), row("q", accent="x", s=1, n=10), row("p", accent="y", s=1, n=5), row("p", accent="z", n=20)])
    got = {r["accent"]: (r["p"], r["q"]) for r in agg.slice_pivot(rows, "accent", ["p", "q"]).collect()}
    assert got == {"x": (pytest.approx(2 / 30), None), "z": (0.0, None)}
    by = {(r["dim"], r["value"], r["provider"]): r["errors"] for r in agg.slices(rows).collect()}
    assert by["accent", "x", "p"] == 2 and by["total", None, "p"] == 3 and by["sex", "f", "q"] == 1


def test_headline_modes_and_errors(spark):
    rows = facts(spark, [row(s=1, n=10, rtf=0.1, ord=0), row(c="telephony_clean", s=3, n=10, rtf=0.4, error="late", ord=1), row(c="x", d=5, rtf=math.inf, error="", ord=2), row("q", n=10, rtf=0.2, error="x" * 200, ord=3), row("q", c="telephony_clean", i=1, rtf=0.3, error="late", ord=4), row("r", c="z", rtf=math.inf, d=2, i=2, ord=5)])
    got = {r["provider"]: tuple(r)[1:] for r in agg.headline(rows).collect()}
    assert got["p"] == (0.1, 0.3, pytest.approx(3.0), 0.4)
    assert got["q"] == (0.0, 0.1, None, 0.3) and got["r"] == (None, None, None, 0.0)
    same = {r["provider"]: r["median_rtf"] for r in agg.exact_upper_median(rows, "rtf", "provider").collect()}
    assert same == {p: v[3] for p, v in got.items()}
    assert {r["provider"]: r["read"] for r in agg.failure_mode(rows).collect()} == {"p": "drops audio", "q": "hallucinates", "r": "drops audio"}
    assert [(r["provider"], len(r["error"]), r["n"]) for r in agg.error_histogram(rows, "ord").collect()] == [("p", 4, 1), ("q", 110, 1), ("q", 4, 1)]
    shade = {(r["condition"], r["provider"]): r["colour"] for r in agg.heat_cells(rows.where("provider <> 'r'")).collect()}
    assert shade["wideband_clean", "q"] == "rgb(21,128,61)"


def test_intervals(spark):
    rng = random.Random(3)
    rows = [(f"c{k % 2}", k, rng.randint(0, 4), rng.randint(5, 12)) for k in range(90)]
    df = spark.createDataFrame(rows, "cell string, o int, errors long, reference_words long")
    exact = {r["cell"]: (r["lo"], r["hi"]) for r in bootstrap_exact(df.repartition(7), ["cell"], "o").collect()}
    native = {r["cell"]: (r["lo"], r["hi"]) for r in bootstrap_native(df.repartition(5), ["cell"], "o").collect()}
    assert native == {r["cell"]: (r["lo"], r["hi"]) for r in bootstrap_native(df.coalesce(1), ["cell"], "o").collect()}
    for cell in ("c0", "c1"):
        own = [r for r in rows if r[0] == cell]
        rate = sum(r[2] for r in own) / sum(r[3] for r in own)
        draws = random.Random(0)
        picks = [[draws.randrange(len(own)) for _ in own] for _ in range(1000)]
        rates = sorted(sum(own[k][2] for k in p) / sum(own[k][3] for k in p) for p in picks)
        assert exact[cell] == (pytest.approx(rates[25]), pytest.approx(rates[975]))
        assert exact[cell][0] <= rate <= exact[cell][1]
        assert np.allclose(native[cell], exact[cell], atol=0.02)
    assert percentile_interval(np.array([]), np.array([])) == (0.0, 0.0)
    assert percentile_interval(np.ones(12), np.full(12, 6), 200) == (pytest.approx(1 / 6), pytest.approx(1 / 6))


def test_costs_and_budget(spark):
    hour = spark.createDataFrame([(3600.0,)], "duration_s double")
    usd = {r["provider"]: r["usd"] for r in cost_rollup(hour, providers_table(spark, ["mock", "deepgram", "openai", "odd"]), 7).collect()}
    assert usd == {"mock": 0.0, "deepgram": pytest.approx(1.806), "openai": pytest.approx(2.52), "odd": 0.0, "TOTAL": pytest.approx(4.326)}
    cells = spark.createDataFrame([(u, c, 0.4) for u in range(4) for c in range(3)], "utt_ord int, cond_ord int, cost_usd double")
    kept = budget_cut(cells, 1.0, ["utt_ord", "cond_ord"]).select("utt_ord", "cond_ord").collect()
    assert sorted(map(tuple, kept)) == [(0, 0), (0, 1), (0, 2)]
    assert budget_cut(cells, 0.0, ["utt_ord", "cond_ord"]).count() == 12


def test_conditions(spark):
    assert [c.name for c in m.select_conditions(["telephony_alaw", "wideband_clean"])] == ["telephony_alaw", "wideband_clean"] and len(m.select_conditions([])) == 7
    with pytest.raises(ValueError, match="nope"):
        m.select_conditions(["nope"])
    assert m.unknown_conditions(spark, ["telephony_alaw", "b", "a"]) == ["b", "a"]


def test_manifest_round_trip(spark, tmp_path):
    body = {"license": "x", "utterances": [{"id": "u1", "audio_path": "a.wav", "reference": "hi", "odd": 1}, {"id": "u2", "audio_path": "/b.wav", "reference": "ho", "accent": "scots", "duration_s": 2.5}]}
    (tmp_path / "set.json").write_text(json.dumps(body))
    rows = m.read_manifest(spark, str(tmp_path / "set.json")).orderBy("utt_ord").collect()
    assert [(r["manifest"], r["id"], r["accent"], r["locale"], r["duration_s"]) for r in rows] == [("set", "u1", "unknown", "en", 0.0), ("set", "u2", "scots", "en", 2.5)]
    assert rows[0]["audio_path"] == f"{tmp_path}/a.wav" and rows[1]["audio_path"] == "/b.wav"
    m.write_manifest(m.read_manifest(spark, str(tmp_path / "set.json")), str(tmp_path / "copy.json"), "copy")
    again = m.read_manifest(spark, str(tmp_path / "copy.json")).orderBy("utt_ord").collect()
    assert [r["reference"] for r in again] == ["hi", "ho"] and again[0]["manifest"] == "copy"
    assert m.total_audio_seconds(m.read_manifest(spark, str(tmp_path / "copy.json"))).first()[0] == 2.5


def test_tsv_recipe(spark, tmp_path):
    lines = ["client_id\tpath\tsentence\tage\tgender\taccents", "1\ta.mp3\tOne \"two\"\ttwenties\tmale\tScottish, English", "2\tb.mp3\tno age\t\tmale\tx", "3\tc.mp3\tThree\tthirties\t\tIndian", "4\td.mp3\tno accent\tteens\tmale\t"]
    (tmp_path / "v.tsv").write_text("\n".join(lines))
    got = m.read_validated_tsv(spark, str(tmp_path / "v.tsv"), "/clips").orderBy("utt_ord").collect()
    assert [(r["id"], r["audio_path"], r["reference"], r["accent"], r["age_band"], r["sex"]) for r in got] == [("a", "/clips/a.mp3", 'One "two"', "Scottish", "twenties", "male"), ("c", "/clips/c.mp3", "Three", "Indian", "thirties", "unknown")]


def test_audio_files(spark, tmp_path):
    x = np.array([0.0, 0.5, -0.5, 2.0, -2.0], np.float32)
    data = wav_bytes(x, 8000)
    assert data[:4] == b"RIFF" and np.abs(read_wav(data)[0] - np.clip(x, -1, 1)).max() < 1e-4
    (tmp_path / "a.wav").write_bytes(data)
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    got = {r["path"].rsplit("/", 1)[1]: r for r in read_audio(spark, str(tmp_path)).collect()}
    assert got["a.wav"]["sr"] == 8000 and len(got["a.wav"]["audio"]) == 5 and got["bad.wav"]["audio"] is None
    df = spark.createDataFrame([(bytearray(data),), (bytearray(b"x"),)], "c binary").select(wav_duration("c").alias("s"))
    assert [r["s"] for r in df.collect()] == [5 / 8000, None]
    back = spark.createDataFrame([(x.tolist(), 8000)], "a array<float>, r int").select(encode_wav("a", "r").alias("w")).first()["w"]
    assert bytes(back) == data


def test_providers():
    mock = MockProvider()
    a = mock.transcribe(np.zeros(100, np.float32), 8000, "one two three", "k")
    assert a.text == mock.transcribe(np.zeros(100, np.float32), 8000, "one two three", "k").text and a.cost_usd == 0 and a.audio_s == 100 / 8000
    assert Transcript("", "x", 1.0, 0.0, 0.0).rtf == math.inf and Transcript("", "x", 1.0, 2.0, 0.0).rtf == 0.5
    assert DeepgramProvider(api_key="").transcribe(np.zeros(8), 8).error.startswith("missing API key")
    waits = []

    class Flaky(HttpProvider):
        name = "deepgram_nova"

        def send(self, wav, sr):
            if len(waits) < 2:
                raise OSError("down")
            return "text", None

    ok = Flaky(api_key="k", pause=waits.append).transcribe(np.zeros(8000, np.float32), 8000)
    assert (ok.text, ok.error, waits) == ("text", None, [1, 2]) and ok.cost_usd == pytest.approx(0.258 / 3600)
    waits.clear()
    bad = type("Down", (HttpProvider,), {"send": lambda self, w, s: (_ for _ in ()).throw(OSError("down"))})(api_key="k", pause=waits.append).transcribe(np.zeros(8), 8)
    assert (bad.text, bad.cost_usd, bad.error, waits) == ("", 0.0, "OSError: down", [1, 2, 4])


def test_end_to_end(spark, tmp_path):
    conditions = m.select_conditions(["wideband_clean", "telephony_clean", "telephony_lossy_3pct"])
    corpus = sample_corpus(spark, 1).where("utt_ord < 6").persist()
    assert run_benchmark(corpus, ["mock", "deepgram"], conditions, dry_run=True)[0] is None
    with pytest.raises(BudgetExceeded):
        run_benchmark(corpus, ["deepgram"], conditions)
    with pytest.raises(ValueError):
        run_benchmark(corpus.where("false"), ["mock"], conditions)
    silent = corpus.withColumn("audio", F.when(F.col("utt_ord") != 2, F.col("audio")))
    results, plan = run_benchmark(silent, ["mock"], conditions)
    rows = results.collect()
    assert plan["cells"] == 18 and len(rows) == 15 and plan["actual_cost_usd"] == 0 and plan["skipped_utterances"] == 1  # an unreadable signal is left out
    assert len({r["ord"] for r in rows}) == 15 and all(r["wer"] >= 0 for r in rows)
    path = m.write_results(results, plan, str(tmp_path))
    plan2, stored = m.read_results(spark, path)
    assert plan2["conditions"] == plan["conditions"] and stored.count() == 15
    paths = build_report(stored, plan2, str(tmp_path), NormalizerConfig())
    text = open(paths["markdown"]).read()
    assert all(x in text for x in ("## Clean speech", "## Conditions", "## Domains", "## Kinds of error", "without readable audio: 1")) and "## Accents" not in text and "telephony_lossy_3pct" in text
    assert open(paths["svg"]).read().startswith("<svg")
    calls, spent = run_benchmark(corpus, ["deepgram"], conditions, max_cost_usd=1.0, batch=2)
    assert {r["error"] for r in calls.collect()} == {"missing API key (set DEEPGRAM_API_KEY)"} and spent["actual_cost_usd"] == 0


def test_rendering():
    assert percent(None) == "-" and percent(math.inf) == "inf" and percent(0.0465) in ("4.6", "4.7")
    assert markdown_table([]) == "_no data_\n" and markdown_table([["a", "b"], ["1", "2"]]).splitlines()[1] == "|---|---|"
    assert "#6b7280" in heatmap_svg({}, ["p"], ["c"])


def test_corpus_rows(spark):
    rows = sample_rows(spark, 3).orderBy("utt_ord").collect()
    assert len(rows) == 45 and [r["utt_ord"] for r in rows] == list(range(45)) and len({r["id"] for r in rows}) == 45
    assert len(voice_rows(spark, ["a"], 14).collect()) == 14


def test_stream_equals_batch(spark, tmp_path):
    from earshot.streaming.live import live_wer, results_stream, start_live_wer

    rows = [("u", "p", "c", "a b c", "a x c", 0.0, 0, 0, 0, 0, 0.1, 0.1, 0.0, "a", "b", "s", "d", None), ("v", "p", "c", "one two", "12", 0.0, 0, 0, 0, 0, 0.1, 0.1, 0.0, "a", "b", "s", "d", None)]
    df = spark.createDataFrame(rows, m.RESULT)
    df.limit(1).write.parquet(str(tmp_path / "in"))
    q = start_live_wer(results_stream(spark, str(tmp_path / "in")), "live_rates", str(tmp_path / "state"))
    q.processAllAvailable()
    df.where("utterance_id = 'v'").write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    got = [tuple(r) for r in spark.table("live_rates").collect()]
    q.stop()
    assert got == [tuple(r) for r in live_wer(df).collect()]


def test_intervals_in_parts(monkeypatch):
    """Draws made a few resamples at a time are those of the generator."""
    from earshot.operators import bootstrap

    rng = np.random.default_rng(2)
    e, r = rng.integers(0, 4, 70), rng.integers(4, 9, 70)
    whole = percentile_interval(e, r)
    monkeypatch.setattr(bootstrap, "_DRAWS", 500)
    assert percentile_interval(e, r) == whole
    draws, words = random.Random(0), np.concatenate(list(bootstrap.twister_draws(70, 30, 0)))
    assert words.tolist() == [[draws.randrange(70) for _ in range(70)] for _ in range(30)]


def test_single_list_of_pairs(spark):
    from earshot import bootstrap_ci, corpus_wer

    pairs = [("one cat", "one cat"), ("a b c", "a x c"), ("", ""), ("yes", "yes indeed")] * 6
    got = corpus_wer(pairs).first()
    assert (got["substitutions"], got["insertions"], got["reference_words"], got["wer"]) == (6, 6, 36, pytest.approx(12 / 36))
    ci = bootstrap_ci(pairs).first()
    assert ci["n"] == 24 and ci["lo"] <= 12 / 36 <= ci["hi"]
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, reference string, hypothesis string").repartition(5)
    assert tuple(bootstrap_ci(table, order="k").first()) == tuple(ci) and tuple(bootstrap_ci([]).first()) == (0, 0.0, 0.0)


def test_running_cost_over_ranges(spark):
    rng = random.Random(5)
    rows = [(u, c, rng.randint(1, 9) / 1000) for u in rng.sample(range(10**6), 700) for c in range(3)]
    for limit in (0.001, 1.0, 5.0, 100.0):
        want, spent = set(), 0
        for u, c, x in sorted(rows):
            if spent <= round(limit * 1000):
                want.add((u, c))
            spent += round(x * 1000)
        got = budget_cut(spark.createDataFrame(rows, "u long, c int, cost_usd double").repartition(6), limit, ["u", "c"])
        assert {(r["u"], r["c"]) for r in got.collect()} == want and got.columns == ["u", "c", "cost_usd"]


def test_upper_median_of_nothing(spark):
    rows = [("a", None), ("a", math.inf), ("b", 3.0), ("b", 1.0), ("b", math.inf), ("c", 2.0), ("c", 2.0), ("c", 5.0), ("c", 1.0)]
    got = {r["p"]: r["median_x"] for r in agg.exact_upper_median(spark.createDataFrame(rows, "p string, x double"), "x", "p").collect()}
    assert got == {"a": 0.0, "b": 3.0, "c": 2.0}


def test_damage_is_greater_on_a_worse_signal():
    """The mock takes dull and flat signals for damaged ones, and spoils the text in proportion."""
    from earshot.providers import damage

    rng = np.random.default_rng(0)
    tone, text = np.sin(np.arange(16000) / 5), " ".join(f"w{k}" for k in range(300))
    errors = {}
    for name, x in (("bright", rng.standard_normal(16000) * np.linspace(0, 1, 16000)), ("dull", tone), ("dull and noisy", tone + 0.05 * rng.standard_normal(16000))):
        heard = MockProvider().transcribe(x.astype(np.float32), 16000, text, "k").text.split()
        errors[name] = damage(x), sum(w not in heard for w in text.split())
    assert [e for _, e in sorted(errors.values())] == sorted(e for _, e in errors.values())


def test_stored_calls_are_not_paid_again(spark, tmp_path, monkeypatch):
    from earshot.plans import planner

    class Paid:
        """A recogniser that costs a dollar an hour and notes its calls in a folder."""

        name = "deepgram_nova"

        def __init__(self, folder="", fail=""):
            self.folder, self.fail = folder, fail

        def transcribe(self, audio, sr, reference="", key=""):
            import os
            import uuid

            with open(os.path.join(self.folder, key.replace("/", "+") + "+" + uuid.uuid4().hex), "w"):
                pass
            bad = bool(self.fail) and key.startswith(self.fail)
            return Transcript("" if bad else reference, "deepgram", 0.1, 1.0, 0.0 if bad else 0.25, "down" if bad else None)

    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    monkeypatch.setitem(planner.REGISTRY, "deepgram", Paid)
    conditions = m.select_conditions(["wideband_clean", "telephony_clean"])
    corpus = sample_corpus(spark, 1).where("utt_ord < 5").persist()
    first = corpus.where("utt_ord = 0").first()["id"]
    seen = lambda: sorted(p.name.rsplit("+", 1)[0] for p in calls.iterdir())
    run = lambda budget, fail="": run_benchmark(corpus, ["deepgram"], conditions, max_cost_usd=budget, batch=2, save_to=store, provider_kwargs={"deepgram": {"folder": str(calls), "fail": fail}})
    results, plan = run(0.6, first)
    # the failed utterance is free, so the budget is passed in the second batch: four calls paid, three in the results
    assert plan["stopped_early"] and plan["actual_cost_usd"] == 1.5 and len(seen()) == 8
    assert plan["cost_of_results_usd"] == 0.75 and results.agg(F.sum("cost_usd")).first()[0] == 0.75
    results, plan = run(9.0)
    assert plan["actual_cost_usd"] == 1.0 and len(seen()) == 12 and "stopped_early" not in plan  # two failed before, two new
    rows = results.collect()
    assert len(rows) == 10 and len({r["ord"] for r in rows}) == 10 and all(r["error"] is None and r["wer"] == 0 for r in rows)
    results, plan = run(9.0)
    assert plan["actual_cost_usd"] == 0 and len(seen()) == 12 and results.count() == 10


def test_durations_come_from_headers(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav_bytes(np.zeros(4000, np.float32), 8000))
    files = read_audio(spark, str(tmp_path)).agg(F.sum("duration_s").alias("s"))
    assert files.first()["s"] == 0.5 and "decode_wav" not in files._jdf.queryExecution().optimizedPlan().toString()


def test_corpus_on_disk(spark, tmp_path):
    from earshot.sources.samples import write_corpus

    path = write_corpus(spark, str(tmp_path / "c"), 1)
    rows = m.read_manifest(spark, path).collect()
    assert len(rows) == 15 and all(read_wav(open(r["audio_path"], "rb").read())[1] == 16000 for r in rows)
    assert m.total_audio_seconds(m.read_manifest(spark, path)).first()[0] == pytest.approx(sum(r["duration_s"] for r in rows)) and rows[0]["duration_s"] > 0
    kept = open(path).read()
    assert write_corpus(spark, str(tmp_path / "c"), 3) == path and open(path).read() == kept  # what is there is kept


def test_results_without_json(spark, tmp_path):
    rows = [("u", "p", "c", "a b c", "a x c", 0.0, 0, 0, 0, 0, 0.1, 0.1, 0.0, "a", "b", "s", "d", None)]
    path = m.write_results(spark.createDataFrame(rows, m.RESULT), {"cells": 1}, str(tmp_path), as_json=False)
    assert spark.read.parquet(path).count() == 1 and json.loads((tmp_path / "plan.json").read_text()) == {"cells": 1} and not (tmp_path / "results.json").exists()
