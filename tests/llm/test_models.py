"""Quality ranking, language ID and language-model scores."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_repeats import LOW, W
from texts import documents

from earshot.llm.langid import ftrl, language_id, temperature
from earshot.llm.lm import lm_scores, pack, pack_keys, unpack, unpack_keys
from earshot.llm.ranking import GRAM_SCALE, NAMES, bradley_terry, features, key_bins, order_statistics, quality_ranking
from earshot.llm.textbuf import chunks

LANGS = {"en": "the of and with from this that river stone cloud", "de": "der die und nicht über straße schön wald haus", "es": "el la niño señor corazón camino sueño agua"}


def crc(i, m):
    return zlib.crc32(b"" if i is None else str(i).encode()) % m


def test_bradley_terry():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(size=300) * 0.3 > 0).astype(float)
    w = bradley_terry(x, y)
    assert w[0] > 0 > w[1] and abs(w[2]) < abs(w[1])
    assert not bradley_terry(x, np.ones(300)).any()


def test_bradley_terry_all_pairs():
    """The gradient over all 200,000 pairs, made one by one, is nothing at the weights."""
    rng = np.random.default_rng(2)
    x = np.clip(rng.normal(size=(900, 6)), -8, 8)
    y = (x @ rng.normal(size=6) + rng.normal(size=900) > 0.4).astype(float)
    w = bradley_terry(x, y)
    good, bad = x[y == 1], x[y == 0]
    assert len(good) * len(bad) > 150_000
    p = 1 / (1 + np.exp((good @ w)[:, None] - (bad @ w)[None]))
    assert np.abs(1e-3 * w - (p.sum(1) @ good - p.sum(0) @ bad) / p.size).max() < 1e-8


def test_order_statistics():
    u = np.concatenate([np.random.default_rng(3).normal(size=1000) * 50, [0.0, -0.0, 7, 7, 7, 1e-300, -1e300]])
    ranks = [0, 1, 499, 500, 1005, 1006]
    assert order_statistics(ranks, lambda k, heads: key_bins(u, k, heads)) == np.sort(u)[ranks].tolist()


def test_quality_learns_from_all_labelled_rows(table):
    """Scores are those of a model in memory of all 21,000 and more labelled training rows."""
    rng = random.Random(12)
    words = "river stone Under the bright, cloud walked home again. 7 BUY!! ### x".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 9))), "en", "a", 0) for k in range(27_000)]
    labels = [(k, int((t.count("i") - t.count("#") + rng.gauss(0, 2)) > 0), 0) for k, t, *_ in rows]
    got = {r["doc_id"]: r["score"] for r in quality_ranking(table(rows), table(labels, "doc_id long, quality int, toxic int")).collect()}
    x = np.concatenate([features(buf) for _, _, buf in chunks(pa.array([r[1] for r in rows]))]).astype(np.float32).astype(float)
    train = np.array([crc(r[0], 5) != 0 for r in rows])
    y = np.array([r[1] for r in labels], float)[train]
    assert len(y) > 21_000
    mean, std = x[train].mean(0), x[train].std(0)
    z = np.clip((x - mean) / np.where(std > 1e-9, std, 1), -8, 8) * np.where(np.arange(x.shape[1]) < len(NAMES), 1, GRAM_SCALE)
    u = z @ bradley_terry(z[train], y)
    t = (u - np.quantile(u[train], 1 - y.mean())) / (u[train].std() / 2) + math.log(0.3 / 0.7)
    assert np.abs(np.array([got[r[0]] for r in rows]) - 1 / (1 + np.exp(-t))).max() < 1e-6


def test_quality(table):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice("river stone under the bright cloud walked home again".split()) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "###", "$$$"]) for _ in range(60))
    rows = [(k, good() if k % 3 else bad(), "en", "a", 0) for k in range(300)] + [(900, None, None, None, None), (901, "", "en", "a", 0), (5, good(), "en", "a", 0), (902, "x " * 20000, None, None, 0)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(300)] + [(7, None, 0), (None, 1, 0), (8888, 1, 1), (10, 1, 0)]
    df = table(rows).withColumn("score", F.lit("x")).withColumn("quality", F.lit(None).cast("int"))  # clashing names
    got = quality_ranking(df, table(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in got)
    held = [(r["predicted"], int(r["doc_id"] % 3 > 0)) for r in got if r["held_out"] and r["doc_id"] < 300]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    none = quality_ranking(df, table([], "doc_id long, quality int, toxic int")).collect()
    assert {round(r["score"], 9) for r in none} == {0.3}
    assert quality_ranking(table([]), table([], "doc_id long, quality int, toxic int")).count() == 0


def test_ftrl_and_temperature():
    rows = [(np.array([k % 2, 2]), np.array([1.0, 1.0]), k % 2) for k in range(40)]
    w = ftrl(rows, 2)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and not w[3:].any()
    logits = np.array([[4.0, 0.0], [4.0, 0.0], [4.0, 0.0], [0.0, 4.0]])
    assert temperature(logits, np.array([0, 0, 1, 1])) > 1.5  # too sure
    assert temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


def test_language(table):
    rng = random.Random(6)
    rows = []
    for k in range(240):
        lang = rng.choice(list(LANGS))
        rows.append((k, " ".join(rng.choice(LANGS[lang].split()) for _ in range(25)), lang, "a", 0))
    rows += [(900, None, "en", None, None), (901, "", "en", "a", 0), (902, "123 !! 45", "en", "a", 0), (903, "der wald " * 9000, None, "a", 0), (3, rows[3][1], rows[3][2], "a", 0)]
    df = table(rows).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit(2))  # clashing names
    got = language_id(df).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["held_out"] == (crc(r["doc_id"], 4) == 2) for r in got)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(by_id[k] == "und" for k in (900, 901, 902)) and by_id[903] == "de"
    held = [(r["lang_pred"], dict((x[0], x[2]) for x in rows)[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] < 240]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert language_id(table([])).count() == 0
    blank = language_id(table([(1, "some text", None, None, None)])).collect()
    assert (blank[0]["lang_pred"], blank[0]["score"]) == ("und", 0.0)


def tokens(t):
    return W.findall((t or "").translate(LOW)) + [None]


def test_lm(table):
    rows = documents(n=50) + [(7, "the the the", "en", "a", 0), (None, "the of", None, None, None)]
    got = lm_scores(table(rows).withColumn("score", F.lit("x"))).collect()
    count = Counter(w for r in rows if crc(r[0], 7) != 2 for w in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    want = sorted((str(r[0]), crc(r[0], 7) == 2, len(tokens(r[1])), sum(count[w] > 0 for w in tokens(r[1])), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(r[1])), 6)) for r in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_scores(table([])).count() == 0
    alone = [k for k in range(200) if crc(k, 7) == 2][:2]
    untrained = lm_scores(table([(k, "a b", None, None, None) for k in alone])).collect()
    assert [(r["n_tokens"], r["train_tokens"], r["score"]) for r in untrained] == [(3, 0, 0.0)] * 2


def test_lm_is_a_distribution(table):
    """After any history the probabilities of all known words, the end and the unknown word sum to 1 at most, and nearly so."""
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "d", "e"]
    rows = [(k, " ".join(rng.choice("ab" if rng.random() < 0.8 else "cde") for _ in range(30)), None, None, None) for k in range(60)]
    one = [(1000 + k, w, None, None, None) for k, w in enumerate(vocabulary)]
    one = [(next(i for i in range(5000 + 100 * k, 9999) if crc(i, 7) == 2), r[1], None, None, None) for k, r in enumerate(one)]
    empty = next(i for i in range(20000, 30000) if crc(i, 7) == 2)
    got = {r["doc_id"]: r["score"] for r in lm_scores(table(rows + one + [(empty, "", None, None, None)])).collect()}
    # P(word) P(end | word) summed over the words, and P(end), can't pass 1
    assert 0 < sum(10 ** got[r[0]] for r in one) + 10 ** got[empty] <= 1 + 1e-9


def reference_scores(rows):
    """Trigram scores in plain Python, with the weights learned event by event; which texts are left out comes from Spark's hash."""
    from pyspark.sql import SparkSession

    ids = SparkSession.getActiveSession().createDataFrame([(r[0],) for r in rows], "k long").select("k", (F.abs(F.xxhash64(F.coalesce("k", F.lit(0)).cast("string"), F.lit(3))) % 10 == 0).alias("left")).collect()
    left = {r["k"]: r["left"] for r in ids}

    def events(text):
        w = ["<s>", "<s>", *tokens(text)]
        return [tuple(w[k - 2 : k + 1]) for k in range(2, len(w))]

    def count(texts):
        c = Counter()
        for t in texts:
            for u, v, w in events(t):
                c.update([(u, v, w), (v, w), (w,), ("h", u, v), ("h", v), "n"])
        return c

    train = [r for r in rows if crc(r[0], 7) != 2]
    kept, full = count(r[1] for r in train if not left[r[0]]), count(r[1] for r in train)
    words = sum(len(k) == 1 and k != "n" for k in full)

    def parts(c, u, v, w):
        h2, h1 = c["h", u, v], c["h", v]
        bucket = ("three", h2.bit_length()) if h2 else ("two", h1.bit_length())
        return bucket, [c[u, v, w] / h2 if h2 else None, c[v, w] / h1 if h1 else None, c[w,] / c["n"], 1 / (words + 1)]

    held = [parts(kept, *e) for r in train if left[r[0]] for e in events(r[1])]
    start = lambda p: [0 if x is None else 1 / sum(y is not None for y in p) for x in p]
    weights, last = {}, -math.inf
    for _ in range(50):
        total, gain = {}, 0.0
        for b, p in held:
            r = [(x or 0) * y for x, y in zip(p, weights.get(b, start(p)))]
            gain += math.log(sum(r)) / len(held)
            t = total.setdefault(b, [0 if x is None else 1e-3 for x in p])
            for k in range(4):
                t[k] += r[k] / sum(r)
        weights = {b: [x / sum(t) for x in t] for b, t in total.items()}
        if gain - last < 1e-6:
            break
        last = gain

    def score(text):
        out = 0.0
        for e in events(text):
            b, p = parts(full, *e)
            w = [x * (1 - 1e-4) for x in weights.get(b, start(p))]
            out += math.log10(sum((x or 0) * y for x, y in zip(p, w)) + 1e-4 * p[3])
        return out

    return sorted((str(r[0]), round(score(r[1]), 3)) for r in rows)


def test_lm_against_all_trigrams(table):
    rows = documents(n=80)
    got = lm_scores(table(rows)).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 3)) for r in got) == reference_scores(rows)


def test_lm_counts_rare_histories(table):
    """A word that always follows another is likely after it, however rare both are among the tokens."""
    train = [k for k in range(5000) if crc(k, 7) != 2]
    odd, even = [k for k in range(5000) if crc(k, 7) == 2][:2]
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(4000)}" for _ in range(20)) + f" left{k % 400} right{k % 400}", None, None, None) for k in train[:2000]]
    got = {r["doc_id"]: r["score"] for r in lm_scores(table(rows + [(odd, "left7 right7", None, None, None), (even, "left7 right8", None, None, None)])).collect()}
    assert got[odd] > got[even] + 1


def test_lm_packs_keys_and_counts():
    rng = np.random.default_rng(4)
    for n, high in ((0, 2), (1, 2**63), (300, 2**20), (5000, 2**63)):
        k = np.unique(rng.integers(0, high, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        assert (unpack_keys(pack_keys(k)) == k).all()
        c = rng.integers(0, 400, n)
        assert (unpack(pack(c), n) == c).all()


def test_lm_sums_large_blocks_by_parts(monkeypatch):
    from earshot.llm import lm

    rng = np.random.default_rng(5)
    keys = [np.unique(rng.integers(0, 500, 300, dtype=np.uint64) * np.uint64(2**54) + np.uint64(7)) for _ in range(4)]
    rows = [(b, u, u == 3, *[lm.pack_keys(k[lm.bucket_of(k, 2) == b])] * 3, *[lm.pack(np.full((lm.bucket_of(k, 2) == b).sum(), u + 1))] * 3) for u, k in enumerate(keys) for b in range(2)]
    run = lambda: [b.to_pylist() for b in lm._answer(2)(iter([lm._batch(rows, lm._KEYS)]))]
    whole = run()
    monkeypatch.setattr(lm, "_SPLIT", 50)
    assert run() == whole
    all_counts = Counter()
    for u, k in enumerate(keys):
        all_counts.update({int(x): u + 1 for x in k})
    got = next(r for b in whole for r in b if r["unit"] == 0 and r["bucket"] == 0)
    k = keys[0][lm.bucket_of(keys[0], 2) == 0]
    assert unpack(got["x2"], len(k)).tolist() == [all_counts[int(x)] for x in k]


def test_language_beyond_the_first_plane():
    from earshot.llm.langid import grams
    from earshot.llm.textbuf import Buf

    texts = [t.encode() for t in ("😀 😀🎉", "12 😀 3", "\U00010400", "\U00010428", "漢😀")]
    f, off, has, _ = grams(Buf(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])))
    assert has.tolist() == [False, False, True, True, True]
    assert (f[:, off[2] : off[3]] == f[:, off[3] : off[4]]).all()  # lower-cased


def test_lm_of_few_documents(table):
    """A word that the training texts lack leaves a finite score, however few they are."""
    train = [k for k in range(100) if crc(k, 7) != 2][:3]
    held = next(k for k in range(100) if crc(k, 7) == 2)
    got = lm_scores(table([(k, "a b", None, None, None) for k in train] + [(held, "unseen", None, None, None)])).collect()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
