"""BPE against the tokenizers library, mixing against its rules, top-k search against brute force, and the pipeline."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F
from texts import documents

from earshot.llm.bpe import Tokenizer, bpe_digests, bpe_round_trip, load_vocabulary
from earshot.llm.graph import connected_components
from earshot.llm.mixing import min_cost_flow, mix_sources, targets, word_count
from earshot.llm.topk import quantised, top_k

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["it's we'll 'tis 's 're x''s !'s '' 'll 'LL I'D don't 'sss", "  ", "<|endoftext|>a b<|startoftext|> c<|endoftext|>", "ΣΑΣ ΟΔΟΣ İstanbul ẞ", "é 가 ４５ ²½", "a\x1cb\x85c", "😀👨‍👩‍👧 !!!", "a" * 900, "the" * 300, "_a_b-c", None, ""]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_encoder(library):
    tok, rng = Tokenizer(load_vocabulary(PATH)), random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyz'  \n!.,0123ÉéßñΣ日😀́"
    texts = [t for t in ODD if t] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(800)]
    parts = [t for t in library.get_vocab() if t.isascii()]
    texts += ["".join(rng.choice(parts).replace("</w>", rng.choice(["", " "])) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    ids, n = tok.encode(texts)
    off = np.concatenate([[0], np.cumsum(n)])
    for k, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[off[k] : off[k + 1]].tolist() == want.ids, texts[k]
        assert tok.decode(ids[off[k] : off[k + 1]]).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_bpe(table, library):
    rows = documents() + [(2000 + k, t, None, None, None) for k, t in enumerate(ODD)]
    df = table(rows).withColumn("ids", F.lit("x"))
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in bpe_round_trip(df, PATH).collect()) == sorted(want)
    digests = [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, ids, t in want]
    assert sorted(tuple(r) for r in bpe_digests(df, PATH).collect()) == sorted(digests)
    assert bpe_digests(table([]), PATH).count() == 0


def test_targets():
    t = targets({"a": 100, "b": 100, None: 100})
    assert t == {"a": 200.0, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)} and sum(t.values()) == pytest.approx(450)
    assert targets({}) == {} and targets({"a": 0, "b": 10}) == {"a": 0.0, "b": 15.0}


def test_flow():
    # the shared pattern serves the source that has nothing else
    assert min_cost_flow([10, 10], [[0], [0, 1]], [10, 10], 2) == [10, 10]
    assert min_cost_flow([10, 10], [[0], [0, 1]], [25, 15], 2) == [20, 20]
    assert min_cost_flow([10, 0], [[0], [1]], [5, 5], 2) == [5, 0]
    assert min_cost_flow([10, 10, 10], [[0, 1], [1, 2], [2]], [10, 10, 10], 2) == [10, 10, 10]


def test_mixing(table):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(1, 40)), None, rng.choice("abcdef") if k % 9 else None, 0) for k in range(1500)] + [(3, "w w", None, "a", 0), (9000, None, None, "a", 0), (9001, "", None, None, 0)]
    df = table(rows).withColumn("copies", F.lit("x"))
    mixed = mix_sources(df, word_count("text"), F.array("source"))
    got, info = mixed.collect(), {r["source"]: r for r in mixed.source_info.collect()}
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").split())
    want = targets(size)
    assert len(got) == len(rows) and {s: r["source_size"] for s, r in info.items()} == size
    for s, t in want.items():
        own = [r for r in got if r["sources"] == [s]]
        assert abs(sum(r["taken"] for r in own) - t) <= 3 and info[s]["target"] == pytest.approx(t)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    again = mix_sources(table(rows, parts=5), word_count("text"), F.array("source")).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in again) == sorted((r["doc_id"], r["size"], r["taken"]) for r in got)
    empty = mix_sources(table([]), word_count("text"), F.array("source"))
    assert empty.count() == 0 and empty.source_info.count() == 0


def test_mixing_overlap(table):
    rows = [(k, "w " * 10, None, ["a", "a,b", "b"][k % 3], 0) for k in range(300)]
    got = mix_sources(table(rows), word_count("text"), F.split("source", ","), share=1.0).collect()
    assert sum(r["taken"] for r in got) > 0 and {len(r["sources"]) for r in got} == {1, 2}


def test_top_k(table):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    vectors = [(centres[k % 5] + rng.normal(size=8) * 0.1).tolist() for k in range(700)]
    rows = [(k, v, 0) for k, v in enumerate(vectors)] + [(1000 + k, vectors[50], 0) for k in range(7)] + [(50, vectors[50], 0), (2000, None, 0), (2050, [float("nan")] * 8, 0), (2100, [None] + [1.0] * 7, 0), (2150, [float("inf")] * 8, 0), (2200, [], 0), (2250, [1.0, 2.0], 0), (2251, [3.0, -2.0], 0)]
    df = table(rows, "vec_id long, embedding array<double>, score int", parts=3)
    got = top_k(df, F.col("vec_id") % 50 == 0, quantised("embedding"), shard_rows=100).collect()
    good = [(i, np.floor(256 * np.array(v, float))) for i, v, _ in rows if v and None not in v and np.isfinite(np.array(v, float)).all()]
    want = []
    for n, (i, q) in enumerate(good):
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for m, (j, v) in enumerate(good) if m != n and len(v) == len(q))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert top_k(table([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, quantised("embedding")).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5040)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    alone = {a for a, b in edges if a == b}
    assert all(got.get(x, x) == m for x, m in label.items()) and set(got) >= {x for a, b in edges if a != b for x in (a, b)} - alone


def test_components_tasks(spark):
    """A few edges take a few tasks, however many partitions there are; edges beyond a task go through the rounds."""
    rng = random.Random(9)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5040)]
    label = {x: x for a, b in edges if a != b for x in (a, b)}
    for _ in range(80):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    sc, df = spark.sparkContext, spark.createDataFrame(edges, "a long, b long")
    sc.setJobGroup("components", "")
    try:
        assert sorted(map(tuple, connected_components(df).collect())) == sorted(label.items())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("components") for s in told.getJobInfo(j).stageIds}
    assert sum(x.numTasks for x in map(told.getStageInfo, stages) if x) <= 60
    for most in (50, 300):
        assert sorted(map(tuple, connected_components(df, edges_a_task=most).collect())) == sorted(label.items())


def test_pipeline(spark, table, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    vocabulary = {"en": [f"river{k}" for k in range(60)] + ["the", "of", "and"], "de": [f"straße{k}" for k in range(60)] + ["der", "die", "und"]}
    text = lambda lang, n: "\n".join(" ".join(rng.choice(vocabulary[lang]) for _ in range(12)) for _ in range(n))
    rows = []
    for k in range(120):
        lang = rng.choice(["en", "de"])
        rows.append((k, text(lang, rng.randint(3, 6)), lang, rng.choice("abc"), 0))
    rows += [(500, rows[3][1], rows[3][2], "a", 0), (501, rows[4][1] + "\n" + text("en", 1), "en", "a", 0), (502, "12 34", "en", "a", 0), (503, None, None, None, None)]
    docs = table(rows, name="documents.parquet")
    steps = []
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        steps.append(now.collect())
        if k < 4:
            assert now.columns == docs.columns
    ids = [{r["doc_id"] for r in s} for s in steps]
    assert ids[0] == {*range(120), 500, 501}
    assert ids[1] == {*range(120), 501}  # an exact copy has no line left, of 501 one line stays
    assert [r["text"] for r in steps[1] if r["doc_id"] == 501][0].count("\n") == 0
    assert ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] == ids[3]
    assert len(steps[4]) == len(steps[3]) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in steps[4])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(steps[4])
