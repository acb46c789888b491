"""Normalisation and alignment."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from earshot.functions.text import NormalizerConfig, normalize
from earshot.operators.align import align_counts, char_errors, error_counts, word_errors

GOLDEN = [("Hello, World!", "hello world"), ("i need twenty five of them", "i need 25 of them"), ("one hundred two", "102"), ("three thousand", "3000"), ("claim number four eight two", "claim number 482"), ("one two three", "123"), ("twenty five", "25"), (None, ""), ("one hundred and two", "100 and 2"), ("nineteen ninety five", "114"), ("oh no", "0 no"), ("hundred cats", "hundred cats"), ("two thousand three hundred", "2300"), ("zero hundred", "100"), ("one two hundred", "300"), ("can't", "cannot"), ("won't", "will not"), ("bandit's", "bandit is"), ("let's", "let us"), ("  a \t b ", "a b"), ("ﬁne ①", "fine 1"), ("snake_case é", "snake_case é"), ("number words: one, two", "number words 12"), ("hundred hundred", "hundred hundred"), ("one " + "hundred " * 30, None)]


def test_goldens(spark):
    rows = [(k, a, b) for k, (a, b) in enumerate(GOLDEN)]
    got = spark.createDataFrame(rows, "k int, a string, b string").select("k", "b", normalize(F.col("a")).alias("n")).collect()
    for r in got:
        if r["b"] is not None:
            assert r["n"] == r["b"], r
    assert next(r["n"] for r in got if r["k"] == len(GOLDEN) - 1).startswith("one hundred")  # a number beyond 38 digits stays in words


def test_options(spark):
    df = spark.createDataFrame([("Um, I uh need TWO!",)], "t string")
    n = lambda **kw: df.select(normalize(F.col("t"), NormalizerConfig(**kw))).first()[0]
    assert n() == "um i uh need 2" and n(strip_filler=True) == "i need 2"
    assert n(lowercase=False, spell_out_numbers=False) == "Um I uh need TWO"
    assert n(strip_punctuation=False, spell_out_numbers=False) == "um, i uh need two!"
    assert NormalizerConfig().describe().startswith("lowercase, strip_punctuation") and NormalizerConfig(*[False] * 6).describe() == "none"


def table_of(ref, hyp):
    """Counts by the plain table of all cells."""
    above = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for i, a in enumerate(ref, 1):
        row = [(i, 0, i, 0)]
        for j, b in enumerate(hyp, 1):
            if a == b:
                row.append(above[j - 1])
                continue
            s, d, n = above[j - 1], above[j], row[-1]
            options = [(s[0] + 1, 0, (s[1] + 1, s[2], s[3])), (d[0] + 1, 1, (d[1], d[2] + 1, d[3])), (n[0] + 1, 2, (n[1], n[2], n[3] + 1))]
            best = min(options)
            row.append((best[0], *best[2]))
        above = row
    return above[-1][1:]


def test_alignment_against_the_table():
    rng = random.Random(1)
    refs = [[rng.choice("abcd") for _ in range(rng.randint(0, 25))] for _ in range(400)]
    hyps = [[rng.choice("abcd") for _ in range(rng.randint(0, 25))] if rng.random() < 0.3 else [rng.choice("abcd") if rng.random() < 0.2 else x for x in r if rng.random() > 0.1] for r in refs]
    got = align_counts(refs, hyps)
    for r, h, g in zip(refs, hyps, got.tolist(), strict=True):
        assert tuple(g[:3]) == table_of(r, h) and g[3] == len(r)
        assert g[2] - g[1] == len(h) - len(r)


@pytest.mark.parametrize("ref,hyp,want", [("the quick brown fox", "the quick brown fox", (0, 0, 0, 4)), ("the quick brown fox", "the quick red", (1, 1, 0, 4)), ("yes", "yes and then i would like to book an appointment tomorrow", (0, 0, 10, 1)), ("alpha bravo charlie", "", (0, 3, 0, 3)), ("", "spurious words here", (0, 0, 3, 0)), (None, None, (0, 0, 0, 0))])
def test_word_errors(spark, ref, hyp, want):
    df = spark.createDataFrame([(ref, hyp)], "r string, h string")
    assert tuple(df.select(word_errors(F.col("r"), F.col("h"))).first()[0]) == want


def test_char_errors_ignore_spaces(spark):
    df = spark.createDataFrame([("hello world", "helloworld"), ("abc", "abd")], "r string, h string")
    assert [tuple(r[0]) for r in df.select(char_errors(F.col("r"), F.col("h"))).collect()] == [(0, 0, 0, 10), (1, 0, 0, 3)]


def test_partitioning_does_not_matter(spark):
    df = spark.range(300).select(F.split(F.concat_ws(" ", F.col("id") % 7, F.col("id") % 5, F.lit("x")), " ").alias("r"), F.split(F.concat_ws(" ", F.col("id") % 5, F.lit("x")), " ").alias("h"))
    one, many = (sorted(tuple(r[0]) for r in df.repartition(n).select(error_counts(F.col("r"), F.col("h"))).collect()) for n in (1, 16))
    assert one == many


def test_nfkc_only_touches_other_characters(spark):
    texts = ["plain", "ﬁ", "Å", "ｆｕｌｌ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(normalize(F.col("t"), NormalizerConfig(lowercase=False))).collect()]
    assert got == [unicodedata.normalize("NFKC", t) for t in texts]


def test_public_names():
    import earshot

    assert all(callable(getattr(earshot, name)) for name in earshot.__all__)
    with pytest.raises(AttributeError):
        earshot.nothing  # noqa: B018


def folded(text):
    """Number words of a normalised text folded word by word."""
    ones = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    value = {w: k for k, w in enumerate(ones)} | {"oh": 0} | {w: 10 * k for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
    digit = set(ones[:10]) | {"oh"}

    def number(run):
        if len(run) > 1 and all(w in digit for w in run):
            return "".join(str(value[w]) for w in run)
        total = part = 0
        seen = False
        for w in run:
            if w in value:
                part, seen = part + value[w], True
            elif not seen:
                return None
            elif w == "hundred":
                part = max(part, 1) * 100
            else:
                total, part = total + max(part, 1) * 1000, 0
        out = total + part
        return str(out) if seen and out < 10**38 else None

    out, run = [], []
    for w in [*text.split(" "), None]:
        if w is not None and (w in value or w in ("hundred", "thousand")):
            run.append(w)
            continue
        if run:
            got = number(run)
            out += [got] if got is not None else run
            run = []
        out.append(w)
    return " ".join(out[:-1])


def test_number_words_of_whole_conversations(spark):
    from earshot.queries import ODD_WORDS, normalized_plain, number_words

    d = "/root/testdata/sf0.001"
    plain = {(r["conv_id"], r["turn"]): r["normalized"] for r in normalized_plain(spark, d).collect()}
    rows = number_words(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/conversations.parquet").count() and any(w in r["said"] for r in rows for w in ODD_WORDS)
    assert all(r["normalized"] == folded(plain[r["conv_id"], r["turn"]]) for r in rows)
