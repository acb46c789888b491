"""Results that don't depend on splits or colliding hashes, hot groups, large numbers, and clashing names."""

import hashlib
import itertools
import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_repeats import components, measures, removed
from texts import documents

from earshot.llm import jaccard
from earshot.llm.bpe import Tokenizer, default_vocabulary, load_vocabulary
from earshot.llm.common import place
from earshot.llm.jaccard import near_duplicates
from earshot.llm.linededup import dedup_lines
from earshot.llm.lm import lm_scores
from earshot.llm.mixing import min_cost_flow, mix_sources, targets, word_count
from earshot.llm.repetition import RepetitionRules, repetition_quality
from earshot.llm.suffixdedup import remove_repeats
from earshot.llm.textbuf import PRIME, Buf, Prefix
from earshot.llm import textbuf
from earshot.llm.topk import quantised, top_k

CLASH = ["_uid", "n_bytes", "n_removed", "starts", "_key", "_text", "_id", "n_shingles", "component_id", "n_words", "kept", "size", "sources", "_metadata", "score"]


def thue_morse(n, a, b):
    x = a
    y = b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


def test_prefix(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(1, 257, 3000).astype(np.uint64)
    s = rng.integers(0, 1500, 40)
    e = s + rng.integers(0, 1500, 40)
    want = [sum(int(v) * pow(textbuf._BASE, i, PRIME) for i, v in enumerate(data[a:b])) % PRIME for a, b in zip(s, e, strict=True)]
    assert Prefix(data).raw(s, e).tolist() == want
    monkeypatch.setattr(textbuf, "_BLOCK", 700)  # as for texts of several blocks
    monkeypatch.setattr(textbuf, "_powers", [])
    assert Prefix(data).raw(s, e).tolist() == want


def test_strings_that_collide_modulo_powers_of_two(table):
    a, b = thue_morse(11, "x", "y")
    raw = (a + b).encode()
    h = Buf(np.frombuffer(raw, np.uint8), np.array([0, len(a), len(raw)])).hashes(np.array([0, len(a)]), np.array([len(a), len(raw)]))
    assert h[0] != h[1]
    rows = [(1, a, "en", "a", 0), (2, b, "en", "a", 0)]
    assert {r["text"] for r in dedup_lines(table(rows)).collect()} == {a, b}
    tok = Tokenizer(load_vocabulary(default_vocabulary()))
    together, n = tok.encode([a, b])
    alone = [Tokenizer.encode(tok, [t])[0].tolist() for t in (a, b)]
    fresh = Tokenizer(load_vocabulary(default_vocabulary()))
    assert together[: n[0]].tolist() == alone[0] and together[n[0] :].tolist() == alone[1] == fresh.encode([b])[0].tolist() != alone[0]
    twice = [(3, f"{a}\n{b}\n{a} {b} {a} {a} {b} {b}", None, None, None)]
    got = repetition_quality(table(twice)).collect()[0]
    want = measures(twice[0][1], RepetitionRules().ngram_share)
    assert {k: got[k] for k in want} == want
    sets = [(k, " ".join([t] * 3 + ["p", "q"]), None, None, None) for k, t in enumerate((a, b))]
    assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(table(sets)).collect()) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("operator", [lambda d: dedup_lines(d).select("doc_id", "text"), lambda d: remove_repeats(d, 64, digest=True), lambda d: near_duplicates(d).select("doc_id", "n_shingles", "component_id"), lambda d: lm_scores(d)])
def test_other_splits_between_jobs(spark, table, monkeypatch, operator):
    """The number of splits changes after each table that an operator writes."""
    from earshot.llm import common, linededup, lm, suffixdedup

    df = table(documents(n=300), parts=6)
    want = sorted(map(str, operator(df).collect()))
    turn = itertools.cycle(["1", "7", "3"])

    def shared(x, s):
        out = common.shared(x, s)
        s.conf.set("spark.sql.leafNodeDefaultParallelism", next(turn))
        return out

    for module in (linededup, lm, suffixdedup, jaccard):
        monkeypatch.setattr(module, "shared", shared)
    try:
        assert sorted(map(str, operator(df).collect())) == want
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_place(spark, table):
    df = table(documents(), parts=5)
    read = lambda d: {(r["doc_id"], r["text"], r["u"]) for r in place(d, "u").select("doc_id", "text", "u").collect()}
    first = read(df)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    assert read(df) == first and len({x[2] for x in first}) == df.count()
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert read(clashing(df)) == first
    joined = df.join(df.select("doc_id"), "doc_id")  # rows that are no rows of a file are written with their numbers
    assert len({x[2] for x in read(joined)}) == joined.count()
    assert place(df.where("doc_id < 10"), "u").select("u").distinct().count() == 10
    path = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    shutil.copytree(path, path + "-moved")  # names of files, not folders, decide
    assert read(spark.read.parquet(path + "-moved")) == first
    for part in "ab":  # the same names in two folders
        shutil.copytree(path, f"{path}-parts/p={part}", ignore=shutil.ignore_patterns("_*", ".*"))
    twice_ = place(spark.read.parquet(path + "-parts"), "u").select("u")
    assert twice_.distinct().count() == twice_.count() == 2 * len(first)


@pytest.mark.parametrize("hot", [(1, 9), (1, 1), (3, 70)])
def test_hot_cores(table, hot):
    """A common passage with many different surroundings, dealt to finer kinds."""
    rng = random.Random(sum(hot))
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = [(k, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 40))) + passage[rng.randint(0, 30) : rng.randint(90, 130)] + "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 40))), None, None, None) for k in range(70)]
    rows += [(100 + k, rows[0][1], None, None, None) for k in range(5)]
    got = remove_repeats(clashing(table(rows)), 64, hot=hot, passage=64).collect()
    want = [(r[0], *x, x[1]) for r, x in zip(rows, removed([r[1] for r in rows], 64), strict=True)]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["n_passage"]) for r in got) == sorted(want)


@pytest.mark.parametrize("pairs", [4, 0, 10**6])
def test_jaccard_of_mixed_components(table, monkeypatch, pairs):
    """Families that share much with each other, so that lists hold sets of many components."""
    monkeypatch.setattr(jaccard, "_PAIRS_A_SET", pairs)
    rng = random.Random(pairs)
    common = [f"c{k}" for k in range(40)]
    rows = []
    for g in range(30):
        w = common[: rng.randint(30, 40)] + [f"g{g}w{k}" for k in range(rng.randint(0, 12))]
        for k in range(rng.randint(1, 6)):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = f"x{rng.randint(0, 99)}"
            rows.append((g * 10 + k, " ".join(v), "en", "a", 0))
    got = near_duplicates(clashing(table(rows))).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(components(rows))


def test_clashing_names(table):
    rows = documents(n=20)
    df = clashing(table(rows))
    got = repetition_quality(df).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in got) == sorted((r[0], measures(r[1], [5])["n_words"]) for r in rows)
    want = [(r[0], hashlib.sha256(x[3]).hexdigest()) for r, x in zip(rows, removed([r[1] for r in rows], 100), strict=True)]
    assert sorted((r["doc_id"], r["kept_sha256"]) for r in remove_repeats(df, 100, digest=True).collect()) == sorted(want)
    assert lm_scores(df).count() == mix_sources(df, word_count("text"), F.array("source")).count() == len(rows)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1234567.89, 1e12, 1e17, 1e200])
def test_top_k_of_large_components(table, scale):
    rng = np.random.default_rng(int(np.log10(scale)))
    vectors = rng.normal(size=(400, 6)) * scale
    vectors[rng.integers(0, 400, 30)] = vectors[0]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors)] + [(5000, [1e308] * 6, 0)]
    got = top_k(table(rows, "vec_id long, embedding array<double>, score int", parts=3), F.col("vec_id") % 50 == 0, quantised("embedding"), shard_rows=60).collect()
    exact = [[int(x // 1) for x in 256 * v] for v in vectors]
    want = []
    for i in range(0, 400, 50):
        best = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(exact[i], v, strict=True)))), j) for j, v in enumerate(exact) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    if scale < 1e9:  # beyond that scores of 64 bits tie at the largest number
        assert sorted(map(tuple, got)) == sorted(want)
    else:
        assert sorted((r[0], r[1], r[3]) for r in got) == sorted((r[0], r[1], r[3]) for r in want)


def cheapest(supply, members, quota, copies):
    """The largest flow and its least cost, over all ways to send whole units."""
    ways = [[x for x in itertools.product(range(supply[p] * copies + 1), repeat=len(own)) if sum(x) <= supply[p] * copies] for p, own in enumerate(members)]
    best = (0, 0)
    for plan in itertools.product(*ways):
        got = [0] * len(quota)
        for own, x in zip(members, plan, strict=True):
            for s, y in zip(own, x, strict=True):
                got[s] += y
        if all(g <= q for g, q in zip(got, quota, strict=True)):
            cost = sum(c * max(0, min(sum(x) - supply[p] * c, supply[p])) for p, x in enumerate(plan) for c in range(copies))
            best = max(best, (sum(got), -cost))
    return best


def test_flow_is_cheapest():
    rng = random.Random(6)
    for _ in range(120):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 3) for _ in range(n)]
        members = [sorted(rng.sample(range(m), rng.randint(1, min(m, 2)))) for _ in range(n)]
        quota, copies = [rng.randint(0, 5) for _ in range(m)], rng.randint(1, 2)
        sent = min_cost_flow(supply, members, quota, copies)
        cost = sum(c * max(0, min(f - supply[p] * c, supply[p])) for p, f in enumerate(sent) for c in range(copies))
        assert (sum(sent), -cost) == cheapest(supply, members, quota, copies)


def test_mixing_of_overlapping_sources(table):
    """Patterns take the words of the cheapest flow, to the nearest document."""
    rows = [(k, "w " * 10, None, ["a", "a,b", "b", "c"][k % 4], 0) for k in range(400)]
    got = mix_sources(table(rows), word_count("text"), F.split("source", ","), share=1.0, max_patterns=1).collect()
    patterns = [("a",), ("a", "b"), ("b",), ("c",)]
    want = targets({"a": 2000, "b": 2000, "c": 1000}, share=1.0)
    sent = min_cost_flow([1000] * 4, [[0], [0, 1], [1], [2]], [round(want[s]) for s in "abc"], 2)
    for own, f in zip(patterns, sent, strict=True):
        assert abs(sum(r["taken"] for r in got if tuple(r["sources"]) == own) - f) <= 10
    with pytest.raises(ValueError):
        mix_sources(table(rows), word_count("text"), F.split("source", ","), max_patterns=0)
    many = [(k, "w w", None, f"s{k}", 0) for k in range(300)]
    assert mix_sources(table(many), word_count("text"), F.array("source"), max_patterns=1).count() == 300


def test_pipeline_stages(spark, table, tmp_path):
    """Jaccard and mixing stages against brute force, clashing names, no n_chars, and an empty table."""
    import corpus_pipeline as cp

    rows = [(k, *r[1:]) for k, r in enumerate(documents(n=30))] + [(900, "word " * 30_000, "en", "a", 0)]
    docs = clashing(table(rows)).drop("n_chars").withColumn("found_lang", F.lit(1)).withColumn("place_of_row", F.lit(2)).withColumn("copies_taken", F.lit(3)).withColumn("lines_all", F.lit(4))
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = cp.near_copies(spark, docs, "")
    least = {c for _, _, c in components(rows)}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(least)
    taken = cp.mix(spark, docs, "")
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(docs, word_count("text"), F.array("source")).collect()}
    got = [r["doc_id"] for r in taken.collect()]
    assert taken.columns == docs.columns and {k: got.count(k) for k in copies} == copies
    size = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    words = {r[0]: len((r[1] or "").split()) for r in rows}
    for s, want in targets(size).items():
        own = [r[0] for r in rows if r[3] == s]
        assert abs(sum(words[k] * copies[k] for k in own) - want) <= max([words[k] for k in own])
    ids = {r["doc_id"] for r in cp.language(spark, docs, "").collect()}
    assert ids <= {r[0] for r in rows if r[1]}
    assert cp.lines(spark, docs, "").columns == docs.columns
    now = table([])
    for _, stage in cp.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0
