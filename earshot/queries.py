"""Registered queries over the given tables, and the SQL that they are checked against.

Inputs are derived by integer arithmetic that both sides share, always over whole tables and texts:

* facts: result rows, every turn of conversations under three conditions and two providers;
* pairs: every text of benchmark with three hypotheses in which words are dropped, reversed or doubled;
* signals: the vectors of embeddings as short signals;
* numbers: the turns of conversations, in which some words are replaced by number words, contractions and fillers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import signal
from earshot.functions.dsp import CONFIG_SCHEMA, degrade
from earshot.functions.text import NormalizerConfig, char_tokens, normalize, word_tokens
from earshot.operators import aggregate as agg
from earshot.operators.align import char_errors, error_counts, score
from earshot.operators.bootstrap import bootstrap_exact, bootstrap_native
from earshot.plans.planner import budget_cut, cost_rollup, plan_grid, transcribe
from earshot.providers import providers_table
from earshot.sources.manifest import conditions_table
from earshot.sources.samples import SENTENCES, VOICES, sample_rows, voice_rows
from earshot.sources.store import spread

CONDITIONS = ["wideband_clean", "telephony_clean", "telephony_noisy"]
SPOIL = [(2, 4, 1), (5, 12, 3), (12, 25, 8)]
ODD_WORDS = ["one", "hundred", "and", "two", "twenty", "five", "oh", "nineteen", "thousand", "um", "uh", "can't", "let's", "it's", "they're", "ninety"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return spread(_table(spark, sf_dir, "conversations")).select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("utt_ord"), F.coalesce(F.size(words), F.lit(0)).cast("long").alias("words"),
        F.concat(F.lit("a"), (F.col("conv_id") % 4).cast("string")).alias("accent"), F.concat(F.lit("b"), (F.col("turn") % 3).cast("string")).alias("age_band"), F.concat(F.lit("s"), ((F.col("conv_id") + F.col("turn")) % 2).cast("string")).alias("sex"), F.col("role").alias("domain"), "text",
    )


UTTERANCES_SQL = """utterances AS (
  SELECT conv_id::VARCHAR || '_' || turn::VARCHAR AS id, conv_id, turn, conv_id * 1000 + turn AS utt_ord,
    len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words,
    'a' || (conv_id % 4)::VARCHAR AS accent, 'b' || (turn % 3)::VARCHAR AS age_band, 's' || ((conv_id + turn) % 2)::VARCHAR AS sex, role AS domain, text
  FROM conversations)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame(list(enumerate(CONDITIONS)), "c long, condition string")
    p = spark.createDataFrame([(0, "p0"), (1, "p1")], "p long, provider string")
    h = F.col("conv_id") * 31 + F.col("turn") * 17 + F.col("c") * 13 + F.col("p") * 7
    x = utterances(spark, sf_dir).drop("text").crossJoin(F.broadcast(c)).crossJoin(F.broadcast(p)).withColumn("h", h)
    audio = F.col("words") * F.lit(0.4)
    return x.select(
        "id", "conv_id", "turn", "utt_ord", "provider", "condition", (F.col("utt_ord") * 6 + F.col("c") * 2 + F.col("p")).alias("ord"), F.col("words").alias("reference_words"),
        (F.col("h") % 7 * F.col("c") + F.col("h") % 3).alias("substitutions"), (F.col("h") % 5).alias("deletions"), (F.col("h") % 4).alias("insertions"), signal.real_time_factor((F.col("h") % 97) / F.lit(50.0), audio).alias("rtf"),
        (F.col("words") * F.lit(0.001)).alias("cost_usd"), "accent", "age_band", "sex", "domain", F.when(F.col("h") % 29 == 0, F.concat(F.lit("timeout "), (F.col("h") % 3).cast("string"))).alias("error"),
    ).withColumn("errors", F.col("substitutions") + F.col("deletions") + F.col("insertions"))


FACTS_SQL = f"""WITH {UTTERANCES_SQL}, facts0 AS (
  SELECT *, conv_id * 31 + turn * 17 + c * 13 + p * 7 AS h
  FROM utterances, (VALUES (0, 'wideband_clean'), (1, 'telephony_clean'), (2, 'telephony_noisy')) x(c, condition), (VALUES (0, 'p0'), (1, 'p1')) y(p, provider)),
facts1 AS (
  SELECT id, conv_id, turn, utt_ord, provider, condition, utt_ord * 6 + c * 2 + p AS ord, words AS reference_words,
    h % 7 * c + h % 3 AS substitutions, h % 5 AS deletions, h % 4 AS insertions,
    CASE WHEN words = 0 THEN 'inf'::DOUBLE ELSE ((h % 97)::DOUBLE / 50.0::DOUBLE) / (words::DOUBLE * 0.4::DOUBLE) END AS rtf, words::DOUBLE * 0.001::DOUBLE AS cost_usd,
    accent, age_band, sex, domain, CASE WHEN h % 29 = 0 THEN 'timeout ' || (h % 3)::VARCHAR END AS error
  FROM facts0),
facts AS (SELECT *, substitutions + deletions + insertions AS errors FROM facts1)"""
_POOL = "sum(substitutions)::BIGINT AS substitutions, sum(deletions)::BIGINT AS deletions, sum(insertions)::BIGINT AS insertions, sum(reference_words)::BIGINT AS reference_words, sum(errors)::BIGINT AS errors, round(CASE WHEN sum(reference_words) = 0 THEN CASE WHEN sum(errors) = 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE sum(errors)::DOUBLE / sum(reference_words) END, 6) AS wer"


def _r(c: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(c)


def _pooled(df: DataFrame, *by: str) -> DataFrame:
    return agg.pooled(df, *by).withColumn("wer", F.round("wer", 6))


def pooled_by_condition(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(facts(spark, d), "provider", "condition")


def pooled_by_provider(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(facts(spark, d), "provider")


def slices_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return agg.slices(facts(spark, d)).withColumn("wer", F.round("wer", 6))


def _pivot(by: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        x = agg.slice_pivot(facts(spark, d), by, ["p0", "p1"])
        return x.select(by, _r("p0"), _r("p1"))

    return query


def _pivot_sql(by: str) -> str:
    cell = lambda p: f"round(CASE WHEN sum(reference_words) FILTER (provider = '{p}') >= 20 THEN sum(errors) FILTER (provider = '{p}')::DOUBLE / sum(reference_words) FILTER (provider = '{p}') END, 6) AS {p}"
    return f"{FACTS_SQL} SELECT * FROM (SELECT {by}, {cell('p0')}, {cell('p1')} FROM facts GROUP BY {by}) WHERE coalesce(p0, p1) IS NOT NULL"


def headline(spark: SparkSession, d: str) -> DataFrame:
    return agg.headline(facts(spark, d)).select("provider", *[_r(c) for c in ("base_wer", "tel_wer", "degradation", "median_rtf")])


def rtf_upper_median(spark: SparkSession, d: str) -> DataFrame:
    return agg.exact_upper_median(facts(spark, d), "rtf", "provider", "condition").select("provider", "condition", _r("median_rtf"))


def failure_mode(spark: SparkSession, d: str) -> DataFrame:
    return agg.failure_mode(facts(spark, d))


def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    return agg.error_histogram(facts(spark, d), "ord")


def heat_cells(spark: SparkSession, d: str) -> DataFrame:
    return agg.heat_cells(facts(spark, d)).withColumn("wer", F.round("wer", 6))


def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return agg.distinct_values(facts(spark, d))


def bootstrap_ci_native(spark: SparkSession, d: str) -> DataFrame:
    x = bootstrap_native(facts(spark, d), ["provider", "condition"], "ord")
    return x.select("provider", "condition", F.col("n").cast("long").alias("n"), _r("lo"), _r("hi"))


def bootstrap_ci_exact(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap_exact(facts(spark, d), ["provider", "condition"], "ord")


def grid(spark: SparkSession, d: str) -> DataFrame:
    u = utterances(spark, d).select("id", "words")
    x = plan_grid(u, conditions_table(spark).select("cond_ord", F.col("name").alias("condition"), "target_sr", "codec", "snr_db"), providers_table(spark, ["mock", "deepgram"]))
    return x.select("id", "condition", "provider", "target_sr", "codec", "snr_db", F.round(F.col("usd_per_hour") * F.col("words") * 0.4 / 3600, 9).alias("usd"))


def cost_by_provider(spark: SparkSession, d: str) -> DataFrame:
    u = utterances(spark, d).select((F.col("words") * F.lit(0.4)).alias("duration_s"))
    return cost_rollup(u, providers_table(spark, ["mock", "deepgram", "openai", "unlisted"]), 7).select("provider", F.round("usd", 4).alias("usd"))


def budget_cells(spark: SparkSession, d: str) -> DataFrame:
    return budget_cut(facts(spark, d), 5.0, ["utt_ord", "ord"]).select("ord", "id", "provider", "condition")


def conditions_present(spark: SparkSession, d: str) -> DataFrame:
    names = conditions_table(spark).select("cond_ord", F.col("name").alias("condition"))
    return names.join(facts(spark, d).select("condition").distinct(), "condition", "left_semi").select("cond_ord", "condition")


def conditions_absent(spark: SparkSession, d: str) -> DataFrame:
    names = conditions_table(spark).select("cond_ord", F.col("name").alias("condition"))
    return facts(spark, d).select("condition").distinct().join(names, "condition", "left_anti")


def total_audio(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).agg(F.round(F.sum(F.col("words") * F.lit(0.4)), 4).alias("audio_seconds"), F.count(F.lit(1)).alias("utterances"))


def failed_calls(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("error").isNotNull() & (F.col("error") != "")
    return facts(spark, d).groupBy("provider").agg(F.count_if(bad).alias("failed"), F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 6).alias("spent"))


def event_calls(spark: SparkSession, d: str) -> DataFrame:
    """The event log as calls: users deal out to providers, event types are conditions, values latencies."""
    e = _table(spark, d, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), F.col("event_type").alias("condition"), "value", (F.col("event_type") == "error").alias("bad"))
    calls = e.groupBy("provider", "condition").agg(F.count(F.lit(1)).alias("calls"), F.count_if("bad").alias("failed"))
    return calls.join(agg.exact_upper_median(e, "value", "provider", "condition"), ["provider", "condition"]).select("provider", "condition", "calls", "failed", _r("median_value"))


# alignment


def spoiled(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame([(k, *s) for k, s in enumerate(SPOIL)], "c long, dl long, sb long, ins long")
    ref = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    x = spread(_table(spark, d, "benchmark")).select("item_id", ref.alias("ref")).crossJoin(F.broadcast(c))

    def one(w: Column, k: Column) -> Column:
        h = (F.col("item_id") * 31 + k.cast("long") * 7 + F.col("c") * 13) % 100
        return F.when(h < F.col("dl"), F.array().cast("array<string>")).when(h < F.col("dl") + F.col("sb"), F.array(F.reverse(w))).when(h < F.col("dl") + F.col("sb") + F.col("ins"), F.array(w, w)).otherwise(F.array(w))

    return x.withColumn("hyp", F.flatten(F.transform("ref", one))).select("item_id", "c", "ref", "hyp")


PAIRS_SQL = """WITH pairs AS (
  SELECT item_id, c, ref, flatten(list_transform(range(len(ref)), lambda k: CASE
      WHEN (item_id * 31 + k * 7 + c * 13) % 100 < dl THEN []::VARCHAR[] WHEN (item_id * 31 + k * 7 + c * 13) % 100 < dl + sb THEN [reverse(ref[k + 1])]
      WHEN (item_id * 31 + k * 7 + c * 13) % 100 < dl + sb + ins THEN [ref[k + 1], ref[k + 1]] ELSE [ref[k + 1]] END)) AS hyp
  FROM (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ref FROM benchmark), (VALUES (0, 2, 4, 1), (1, 5, 12, 3), (2, 12, 25, 8)) s(c, dl, sb, ins)),
tables AS (
  SELECT item_id, c, len(ref)::BIGINT AS n, len(hyp)::BIGINT AS m, list_reduce(
    list_transform(ref, lambda t: [{'w': t, 'c': 0::BIGINT, 'p': 0::BIGINT, 's': 0::BIGINT, 'd': 0::BIGINT, 'i': 0::BIGINT}]),
    lambda above, x: list_reduce(
      list_transform(range(len(hyp)), lambda j: [{'w': hyp[j + 1], 'c': j, 'p': j, 's': 0::BIGINT, 'd': 0::BIGINT, 'i': 0::BIGINT}]),
      lambda acc, y: list_append(acc, CASE WHEN x[1].w = y[1].w THEN above[y[1].c + 1] ELSE list_min([
        {'w': '', 'c': above[y[1].c + 1].c + 1, 'p': 0::BIGINT, 's': above[y[1].c + 1].s + 1, 'd': above[y[1].c + 1].d, 'i': above[y[1].c + 1].i},
        {'w': '', 'c': above[y[1].c + 2].c + 1, 'p': 1::BIGINT, 's': above[y[1].c + 2].s, 'd': above[y[1].c + 2].d + 1, 'i': above[y[1].c + 2].i},
        {'w': '', 'c': acc[len(acc)].c + 1, 'p': 2::BIGINT, 's': acc[len(acc)].s, 'd': acc[len(acc)].d, 'i': acc[len(acc)].i + 1}]) END),
      [{'w': '', 'c': above[1].c + 1, 'p': 0::BIGINT, 's': 0::BIGINT, 'd': above[1].d + 1, 'i': 0::BIGINT}]),
    list_transform(range(len(hyp) + 1), lambda j: {'w': '', 'c': j, 'p': 0::BIGINT, 's': 0::BIGINT, 'd': 0::BIGINT, 'i': j})) AS last
  FROM pairs),
counts AS (SELECT item_id, c, last[m + 1].s AS substitutions, last[m + 1].d AS deletions, last[m + 1].i AS insertions, n AS reference_words FROM tables)"""


def utterance_errors(spark: SparkSession, d: str) -> DataFrame:
    x = spoiled(spark, d).withColumn("e", error_counts(F.col("ref"), F.col("hyp")))
    return x.select("item_id", "c", "e.substitutions", "e.deletions", "e.insertions", F.col("e.reference_length").alias("reference_words"))


def wer_by_condition(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(utterance_errors(spark, d), "c")


def wer_of_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Normalisation, alignment and pooling over all turns; the hypothesis is the turn with its every seventh word reversed."""
    words = F.split("text", " ")
    said = F.array_join(F.transform(words, lambda w, k: F.when(k % 7 == 6, F.reverse(w)).otherwise(w)), " ")
    x = spread(_table(spark, d, "conversations")).select(F.col("role").alias("provider"), F.lit("all").alias("condition"), F.col("text").alias("reference"), said.alias("hypothesis"))
    return _pooled(score(x), "provider")


def char_errors_of_benchmark(spark: SparkSession, d: str) -> DataFrame:
    x = spoiled(spark, d).select("item_id", "c", char_errors(F.array_join("ref", " "), F.array_join("hyp", " ")).alias("e"))
    return x.select("item_id", "c", "e.*")


# text


def normalized_conversations(spark: SparkSession, d: str) -> DataFrame:
    t = normalize(F.col("text"))
    return spread(_table(spark, d, "conversations")).select("conv_id", "turn", t.alias("normalized"), F.size(word_tokens(t)).cast("long").alias("n_words"), F.size(char_tokens(t)).cast("long").alias("n_chars"))


_STEPS = "list_filter(string_split_regex(regexp_replace({}, '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g'), '\\s+'), lambda w: w <> '')"
_CONTRACT = "lower({})"
for _a, _b in [("can''t", "cannot"), ("won''t", "will not"), ("n''t", " not"), ("''re", " are"), ("''ve", " have"), ("''ll", " will"), ("''d", " would"), ("''m", " am"), ("let''s", "let us"), ("it''s", "it is")]:
    _CONTRACT = f"replace({_CONTRACT}, '{_a}', '{_b}')"
_NUMBERS = "'zero':0,'oh':0,'one':1,'two':2,'three':3,'four':4,'five':5,'six':6,'seven':7,'eight':8,'nine':9,'ten':10,'eleven':11,'twelve':12,'thirteen':13,'fourteen':14,'fifteen':15,'sixteen':16,'seventeen':17,'eighteen':18,'nineteen':19,'twenty':20,'thirty':30,'forty':40,'fifty':50,'sixty':60,'seventy':70,'eighty':80,'ninety':90"


def odd_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every turn with two words in three replaced by number words, contractions and fillers, by place and id."""
    odd = F.array(*map(F.lit, ODD_WORDS))
    place = lambda k: (F.col("conv_id") * 31 + F.col("turn") * 17 + k.cast("long") * 7 + F.floor(k / 3).cast("long")) % (3 * len(ODD_WORDS) // 2)
    said = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w, k: F.when(place(k) < len(ODD_WORDS), F.element_at(odd, place(k).cast("int") + 1)).otherwise(w))
    return spread(_table(spark, d, "conversations")).select("conv_id", "turn", F.array_join(said, " ").alias("said"))


_PLACE = "((conv_id * 31 + turn * 17 + k * 7 + k // 3) % 24)"
_ODD = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ODD_WORDS) + "]"
ODD_SQL = f"SELECT conv_id, turn, array_to_string(list_transform(range(len(w)), lambda k: CASE WHEN {_PLACE} < 16 THEN {_ODD}[{_PLACE} + 1] ELSE w[k + 1] END), ' ') AS said FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS w FROM conversations)"


def normalized_plain(spark: SparkSession, d: str) -> DataFrame:
    cfg = NormalizerConfig(spell_out_numbers=False)
    return odd_turns(spark, d).select("conv_id", "turn", normalize(F.col("said"), cfg).alias("normalized"))


def normalized_fillers(spark: SparkSession, d: str) -> DataFrame:
    cfg = NormalizerConfig(spell_out_numbers=False, strip_filler=True)
    return odd_turns(spark, d).select("conv_id", "turn", normalize(F.col("said"), cfg).alias("normalized"))


def number_words(spark: SparkSession, d: str) -> DataFrame:
    """Number words folded to figures; held against a word-by-word version by a test, as SQL can't express the folding."""
    return odd_turns(spark, d).select("conv_id", "turn", "said", normalize(F.col("said")).alias("normalized"))


# signals


def signals(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "embeddings")).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def mulaw_codes(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select("vec_id", F.array_join(signal.mulaw_codes(F.col("x")), ",").alias("codes"))


def alaw_codes(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select("vec_id", F.array_join(signal.alaw_codes(F.col("x")), ",").alias("codes"))


def companded(spark: SparkSession, d: str) -> DataFrame:
    x = signals(spark, d)
    return x.select("vec_id", *[F.round(signal.mean_power(e(c(F.col("x")))), 9).alias(n) for n, c, e in (("mulaw_power", signal.mulaw_codes, signal.mulaw_expand), ("alaw_power", signal.alaw_codes, signal.alaw_expand))])


def pcm16(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select("vec_id", F.array_join(signal.pcm16(F.col("x")), ",").alias("samples"))


def peaks(spark: SparkSession, d: str) -> DataFrame:
    loud = signals(spark, d).select("vec_id", F.transform("x", lambda v: v * 4.0).alias("x"))
    return loud.select("vec_id", F.round(signal.peak(F.col("x")), 6).alias("peak"), F.round(signal.mean_power(signal.peak_normalize(F.col("x"))), 6).alias("power"))


def frame_statistics(spark: SparkSession, d: str) -> DataFrame:
    x = signals(spark, d).select("vec_id", F.size(signal.frame_powers(F.col("x"), 10)).cast("long").alias("frames"), F.round(signal.active_power(F.col("x"), 10), 9).alias("active"), F.round(signal.mean_power(F.col("x")), 9).alias("power"))
    return x.withColumn("gain", F.round(signal.noise_gain(F.col("active"), F.col("power"), F.lit(15.0)), 6))


def hum_mix(spark: SparkSession, d: str) -> DataFrame:
    x = signals(spark, d).withColumn("z", signal.hum(F.size("x")))
    mixed = signal.mix(F.col("x"), F.col("z"), F.lit(0.5))
    return x.select("vec_id", F.round(signal.mean_power(mixed), 6).alias("power"), F.round(signal.mean_power(F.col("z")), 6).alias("hum_power"))


def loss_scan(spark: SparkSession, d: str) -> DataFrame:
    """Draws are the places of the components by integer arithmetic."""
    u = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda k: ((F.col("vec_id") * 7919 + k * 104729 + 13) % 1009) / F.lit(1009.0))
    states = signal.loss_states(u, 0.10)
    return signals(spark, d).select("vec_id", F.array_join(states, "").alias("lost"))


_X = "(SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
_CODE = "least(255, greatest(0, round_even(({} + 1.0) * 127.5, 0)))::INT"
_MU = _CODE.format("sign(v) * ln(1.0 + 255.0 * abs(least(1, greatest(-1, v)))) / ln(256.0)")
_AL = _CODE.format("sign(v) * CASE WHEN abs(v) < 1 / 87.6 THEN 87.6 * abs(v) / (1 + ln(87.6::DOUBLE)) ELSE (1 + ln(87.6 * least(1, abs(v)))) / (1 + ln(87.6::DOUBLE)) END")
_POWER = "list_sum(list_transform({0}, lambda q: q * q)) / len({0})"


def degraded_signals(spark: SparkSession, d: str) -> DataFrame:
    """Every vector, repeated to a signal, through the standard conditions: rate, length, peak and power."""
    fields = [c.split()[0] for c in CONFIG_SCHEMA.split(", ")]
    audio = F.flatten(F.array_repeat(F.transform("x", lambda v: v.cast("float")), 20))
    x = signals(spark, d).select("vec_id", audio.alias("audio")).crossJoin(F.broadcast(conditions_table(spark)))
    y = x.withColumn("y", degrade(F.col("audio"), F.lit(16000), F.struct(*fields)))
    return y.select("vec_id", F.col("name").alias("condition"), "y.sr", F.size("y.audio").alias("samples"), F.round(signal.peak(F.col("y.audio")), 4).alias("peak"), F.round(signal.mean_power(F.col("y.audio")), 6).alias("power"))


def mock_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts heard by the mock recogniser through a hum, then scored."""
    b = _table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("utt_ord"), F.col("item_id").cast("string").alias("id"), F.col("text").alias("reference"))
    x = b.select("*", F.lit(0).alias("cond_ord"), F.lit("hum").alias("condition"), F.transform(signal.hum(F.lit(800)), lambda v: v.cast("float")).alias("audio"), F.lit(8000).alias("sr"))
    y = transcribe(x, ["mock"]).join(b, "utt_ord").select("utt_ord", "provider", "condition", "reference", "hypothesis")
    return score(y).select("utt_ord", "hypothesis", "substitutions", "deletions", "insertions", "reference_words")


def corpus_rows(spark: SparkSession, d: str) -> DataFrame:
    return sample_rows(spark).select("utt_ord", "id", "reference", "accent", "age_band", "sex", "domain")


def spoken_corpus_rows(spark: SparkSession, d: str) -> DataFrame:
    return voice_rows(spark, ["v0", "v1", "v2", "v3"], 3)


QUERIES = {f.__name__: f for f in (
    pooled_by_condition, pooled_by_provider, slices_grouping_sets, headline, rtf_upper_median, failure_mode, error_histogram, heat_cells, distinct_values, bootstrap_ci_native, bootstrap_ci_exact, grid, cost_by_provider, budget_cells, conditions_present, conditions_absent,
    total_audio, failed_calls, event_calls, utterance_errors, wer_by_condition, wer_of_conversations, char_errors_of_benchmark, normalized_conversations, normalized_plain, normalized_fillers, number_words, mulaw_codes, alaw_codes, companded, pcm16, peaks, frame_statistics, hum_mix,
    loss_scan, degraded_signals, mock_transcripts, corpus_rows, spoken_corpus_rows,
)}
QUERIES |= {f"slice_{c}": _pivot(c) for c in ("accent", "age_band", "domain", "sex")}

_DIMS = ["accent", "age_band", "domain", "sex", "condition"]
_STANDARD = "(VALUES (0, 'wideband_clean', 16000, NULL, NULL::DOUBLE), (1, 'telephony_clean', 8000, 'mulaw', NULL), (2, 'telephony_alaw', 8000, 'alaw', NULL), (3, 'telephony_noisy_15db', 8000, 'mulaw', 15), (4, 'telephony_noisy_5db', 8000, 'mulaw', 5), (5, 'telephony_lossy_3pct', 8000, 'mulaw', NULL), (6, 'telephony_suppressed', 8000, 'mulaw', 15)) k(cond_ord, condition, target_sr, codec, snr_db)"
_UNION = " UNION ALL ".join([f"SELECT '{c}' AS dim, {c} AS value, provider, {_POOL} FROM facts GROUP BY {c}, provider" for c in _DIMS] + [f"SELECT 'total', NULL, provider, {_POOL} FROM facts GROUP BY provider"])
_DRAW = "((((48271 * ((b * 1000003 + k * 7919 + 12345) % 2147483647) + b) % 2147483647) * ((48271 * ((b * 1000003 + k * 7919 + 12345) % 2147483647) + b) % 2147483647) + k) % 2147483647)"
_SHADE = "CASE WHEN t < 0.5 THEN trunc({0} + t / 0.5 * ({1}::DOUBLE - {0}))::INT ELSE trunc({1} + (t - 0.5) / 0.5 * ({2}::DOUBLE - {1}))::INT END::VARCHAR"
ORACLE_SQL = {
    "pooled_by_condition": f"{FACTS_SQL} SELECT provider, condition, {_POOL} FROM facts GROUP BY provider, condition",
    "pooled_by_provider": f"{FACTS_SQL} SELECT provider, {_POOL} FROM facts GROUP BY provider",
    "slices_grouping_sets": f"{FACTS_SQL} {_UNION}",
    "headline": f"""{FACTS_SQL}, h AS (SELECT provider, sum(errors) FILTER (condition = 'wideband_clean')::DOUBLE / sum(reference_words) FILTER (condition = 'wideband_clean') AS b, sum(errors) FILTER (condition = 'telephony_clean')::DOUBLE / sum(reference_words) FILTER (condition = 'telephony_clean') AS t, list_sort(list(rtf) FILTER (rtf <> 'inf'::DOUBLE)) AS r FROM facts GROUP BY provider)
      SELECT provider, round(b, 6) AS base_wer, round(t, 6) AS tel_wer, round(CASE WHEN b > 0 THEN t / b END, 6) AS degradation, round(r[len(r) // 2 + 1], 6) AS median_rtf FROM h""",
    "rtf_upper_median": f"{FACTS_SQL} SELECT provider, condition, round(r[len(r) // 2 + 1], 6) AS median_rtf FROM (SELECT provider, condition, list_sort(list(rtf) FILTER (rtf <> 'inf'::DOUBLE)) AS r FROM facts GROUP BY provider, condition)",
    "failure_mode": f"{FACTS_SQL} SELECT provider, s AS substitutions, d AS deletions, i AS insertions, CASE WHEN s >= d AND s >= i THEN 'mishears' WHEN d >= i THEN 'drops audio' ELSE 'hallucinates' END AS read FROM (SELECT provider, sum(substitutions)::BIGINT s, sum(deletions)::BIGINT d, sum(insertions)::BIGINT i FROM facts GROUP BY provider)",
    "error_histogram": f"{FACTS_SQL} SELECT provider, substr(error, 1, 110) AS error, count(*) AS n, min(ord) AS first_ord FROM facts WHERE error <> '' GROUP BY 1, 2",
    "heat_cells": f"""{FACTS_SQL}, w AS (SELECT condition, provider, sum(errors)::DOUBLE / sum(reference_words) AS wer FROM facts GROUP BY ALL), s AS (SELECT *, greatest(0, least(1, wer / 0.60::DOUBLE)) AS t FROM w)
      SELECT condition, provider, round(wer, 6) AS wer, 'rgb(' || {_SHADE.format(21, 217, 185)} || ',' || {_SHADE.format(128, 165, 28)} || ',' || {_SHADE.format(61, 74, 28)} || ')' AS colour FROM s""",
    "distinct_values": f"{FACTS_SQL} SELECT count(DISTINCT accent) AS accent, count(DISTINCT age_band) AS age_band, count(DISTINCT domain) AS domain, count(DISTINCT sex) AS sex FROM facts",
    "bootstrap_ci_native": f"""{FACTS_SQL}, u AS (SELECT provider, condition, errors, reference_words, row_number() OVER (PARTITION BY provider, condition ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY provider, condition) AS n FROM facts),
      cells AS (SELECT DISTINCT provider, condition, n FROM u), dr AS (SELECT provider, condition, n, b, (({_DRAW} * {_DRAW} + b) % 2147483647) % n AS pos FROM cells, range(1000) x(b), (SELECT unnest(range(0, (SELECT max(n) FROM cells))) AS k) WHERE k < n),
      rates AS (SELECT dr.provider, dr.condition, dr.n, b, sum(errors)::DOUBLE / sum(reference_words) AS r FROM dr JOIN u ON u.provider = dr.provider AND u.condition = dr.condition AND u.pos = dr.pos GROUP BY ALL)
      SELECT provider, condition, n, round(list_sort(list(r))[26], 6) AS lo, round(list_sort(list(r))[976], 6) AS hi FROM rates GROUP BY provider, condition, n""",
    "grid": f"WITH {UTTERANCES_SQL} SELECT id, condition, provider, target_sr, codec, snr_db, round(usd * words * 0.4::DOUBLE / 3600, 9) AS usd FROM utterances, {_STANDARD}, (VALUES ('mock', 0.0::DOUBLE), ('deepgram', 0.258::DOUBLE)) p(provider, usd)",
    "cost_by_provider": f"WITH {UTTERANCES_SQL}, s AS (SELECT sum(words * 0.4::DOUBLE) AS seconds FROM utterances), c AS (SELECT provider, usd * seconds * 7 / 3600 AS usd FROM s, (VALUES ('mock', 0.0::DOUBLE), ('deepgram', 0.258::DOUBLE), ('openai', 0.36::DOUBLE), ('unlisted', 0.0::DOUBLE)) p(provider, usd)) SELECT provider, round(usd, 4) AS usd FROM c UNION ALL SELECT 'TOTAL', round(sum(usd), 4) FROM c",
    "budget_cells": f"{FACTS_SQL}, r AS (SELECT *, sum(cost_usd) OVER (ORDER BY ord) AS running FROM facts) SELECT ord, id, provider, condition FROM r WHERE running - cost_usd <= 5.0::DOUBLE",
    "conditions_present": f"{FACTS_SQL} SELECT cond_ord, condition FROM {_STANDARD} WHERE condition IN (SELECT condition FROM facts)",
    "conditions_absent": f"{FACTS_SQL} SELECT DISTINCT condition FROM facts WHERE condition NOT IN (SELECT condition FROM {_STANDARD})",
    "total_audio": f"WITH {UTTERANCES_SQL} SELECT round(sum(words * 0.4::DOUBLE), 4) AS audio_seconds, count(*) AS utterances FROM utterances",
    "failed_calls": f"{FACTS_SQL} SELECT provider, count(*) FILTER (error <> '') AS failed, count(*) AS calls, round(sum(cost_usd), 6) AS spent FROM facts GROUP BY provider",
    "event_calls": "SELECT provider, condition, count(*) AS calls, count(*) FILTER (condition = 'error') AS failed, round(list_sort(list(value))[len(list(value)) // 2 + 1], 6) AS median_value FROM (SELECT 'p' || (user_id % 3)::VARCHAR AS provider, event_type AS condition, value FROM events) GROUP BY provider, condition",
    "utterance_errors": f"{PAIRS_SQL} SELECT item_id, c, substitutions, deletions, insertions, reference_words FROM counts",
    "wer_by_condition": f"{PAIRS_SQL}, facts AS (SELECT *, substitutions + deletions + insertions AS errors FROM counts) SELECT c, {_POOL} FROM facts GROUP BY c",
    "normalized_conversations": f"SELECT conv_id, turn, array_to_string(w, ' ') AS normalized, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS n_chars FROM (SELECT conv_id, turn, {_STEPS.format(_CONTRACT.format('text'))} AS w FROM conversations)",
    "normalized_plain": f"SELECT conv_id, turn, array_to_string({_STEPS.format(_CONTRACT.format('said'))}, ' ') AS normalized FROM ({ODD_SQL})",
    "normalized_fillers": f"SELECT conv_id, turn, array_to_string(list_filter({_STEPS.format(_CONTRACT.format('said'))}, lambda w: w NOT IN ('uh', 'um', 'erm', 'mm', 'hmm', 'uhh', 'ah')), ' ') AS normalized FROM ({ODD_SQL})",
    "mulaw_codes": f"SELECT vec_id, array_to_string(list_transform(x, lambda v: {_MU}), ',') AS codes FROM {_X}",
    "alaw_codes": f"SELECT vec_id, array_to_string(list_transform(x, lambda v: {_AL}), ',') AS codes FROM {_X}",
    "companded": f"""SELECT vec_id, round({_POWER.format('mu')}, 9) AS mulaw_power, round({_POWER.format('al')}, 9) AS alaw_power FROM (SELECT vec_id,
      list_transform(list_transform(x, lambda v: {_MU} / 127.5::DOUBLE - 1), lambda e: sign(e) * (pow(256.0::DOUBLE, abs(e)) - 1) / 255) AS mu,
      list_transform(list_transform(x, lambda v: {_AL} / 127.5::DOUBLE - 1), lambda e: sign(e) * CASE WHEN abs(e) < 1 / (1 + ln(87.6::DOUBLE)) THEN abs(e) * (1 + ln(87.6::DOUBLE)) / 87.6 ELSE exp(abs(e) * (1 + ln(87.6::DOUBLE)) - 1) / 87.6 END) AS al FROM {_X})""",
    "pcm16": f"SELECT vec_id, array_to_string(list_transform(x, lambda v: trunc(least(1, greatest(-1, v)) * 32767)::INT), ',') AS samples FROM {_X}",
    "peaks": f"SELECT vec_id, round(pk, 6) AS peak, round({_POWER.format('x')} / CASE WHEN pk > 1 THEN pk * pk ELSE 1 END, 6) AS power FROM (SELECT vec_id, x, list_max(list_transform(x, lambda v: abs(v))) AS pk FROM (SELECT vec_id, list_transform(x, lambda v: v * 4) AS x FROM {_X}))",
    "frame_statistics": f"""SELECT *, round(sqrt(active / pow(10, 1.5::DOUBLE) / CASE WHEN power = 0 THEN 1e-12::DOUBLE ELSE power END), 6) AS gain FROM (SELECT vec_id, len(p)::BIGINT AS frames, round(list_avg(list_filter(p, lambda q: q >= list_aggregate(p, 'quantile_cont', 0.7))), 9) AS active, round({_POWER.format('x')}, 9) AS power
      FROM (SELECT vec_id, x, list_transform(range(len(x) // 10), lambda k: list_sum(list_transform(x[k * 10 + 1 : k * 10 + 10], lambda q: q * q)) / 10) AS p FROM {_X}))""",
    "hum_mix": f"SELECT vec_id, round({_POWER.format('y')}, 6) AS power, round({_POWER.format('z')}, 6) AS hum_power FROM (SELECT vec_id, z, list_transform(range(len(x)), lambda k: x[k + 1] + 0.5 * z[k + 1]) AS y FROM (SELECT vec_id, x, list_transform(range(len(x)), lambda k: sin(2 * pi() * 50 * (k / 8000::DOUBLE)) + 0.3::DOUBLE * sin(2 * pi() * 150 * (k / 8000::DOUBLE))) AS z FROM {_X}))",
    "loss_scan": f"""SELECT vec_id, list_reduce(list_transform(range(len(x)), lambda k: (((vec_id * 7919 + k * 104729 + 13) % 1009) / 1009::DOUBLE)::VARCHAR),
      lambda acc, r: acc || CASE WHEN acc[-1] = '1' THEN CASE WHEN r::DOUBLE > 1.0::DOUBLE / 3 THEN '1' ELSE '0' END ELSE CASE WHEN r::DOUBLE < (0.1::DOUBLE * (1.0::DOUBLE / 3)) / 0.9::DOUBLE THEN '1' ELSE '0' END END, '') AS lost FROM {_X}""",
}
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_VOICE = ", ".join(f"({k}, {', '.join(map(_quoted, v[:3]))})" for k, v in enumerate(VOICES))
_SAID = ", ".join(f"({d}, {_quoted(name)}, {k}, {_quoted(x)})" for d, (name, xs) in enumerate(SENTENCES.items()) for k, x in enumerate(xs))
ORACLE_SQL["corpus_rows"] = f"""WITH v(v, accent, age_band, sex) AS (VALUES {_VOICE}), s(d, domain, n, reference) AS (VALUES {_SAID}),
  x AS (SELECT *, (v * 3 + d) * 3 + k AS utt_ord FROM v, (SELECT DISTINCT d, domain FROM s), (VALUES (0), (1), (2)) r(k))
  SELECT utt_ord::INT AS utt_ord, concat_ws('_', accent, age_band, sex, x.domain, k) AS id, reference, accent, age_band, sex, x.domain AS domain FROM x JOIN s ON s.d = x.d AND s.n = (utt_ord + k) % 4"""
ORACLE_SQL["spoken_corpus_rows"] = f"""WITH s(d, domain, n, reference) AS (VALUES {_SAID}), x AS (SELECT v * 3 + k AS utt_ord, 'v' || v AS accent FROM range(4) a(v), range(3) b(k))
  SELECT utt_ord::INT AS utt_ord, accent || '_' || lpad(utt_ord::VARCHAR, 3, '0') AS id, accent, domain, reference FROM x JOIN s ON d * 4 + n = utt_ord % 12"""
ORACLE_SQL |= {f"slice_{c}": _pivot_sql(c) for c in ("accent", "age_band", "domain", "sex")}
