"""Repetition rules, line dedup, suffix dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import documents

from earshot.llm import jaccard, linededup, suffixdedup
from earshot.llm.common import place
from earshot.llm.jaccard import boundary, near_duplicates, prefix, resolve
from earshot.llm.linededup import dedup_lines
from earshot.llm.repetition import RepetitionRules, repetition_quality
from earshot.llm.suffixdedup import column_repeats, remove_repeats

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def measures(t, lengths):
    t = t or ""
    w = W.findall(t)
    lines = Counter(x for x in t.split("\n") if W.search(x))

    def cover(k):
        c = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return {i + j for i in range(len(w) - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(k)}

    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": sum(lines.values()), "n_dup_lines": sum(lines.values()) - len(lines), "n_repeat_words": len(cover(3)), "dup_line_chars": sum(sum(map(len, W.findall(x))) * n for x, n in lines.items() if n > 1)}
    return out | {f"dup_{k}": sum(len(w[i]) for i in cover(k)) for k in lengths}


def test_repetition(table):
    rows = documents() + [(900, "a b c a b c", None, None, None), (901, "x\nx\n\ny # $", "en", "a", 1)]
    rules = RepetitionRules()
    got = repetition_quality(table(rows)).collect()
    want = [(r[0], measures(r[1], rules.ngram_share)) for r in rows]
    key = lambda x: sorted((i, tuple(sorted(m.items()))) for i, m in x)
    assert key((r["doc_id"], {k: r[k] for k in want[0][1]}) for r in got) == key(want)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def within(a, b, bound):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a):
        diagonal, row[0] = row[0], k + 1
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], min(diagonal + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1] <= bound


@pytest.mark.parametrize("rows_to_broadcast,bound", [(50_000, 1), (-1, 1), (50_000, 0), (50_000, 2), (-1, 3)])
def test_line_dedup(table, monkeypatch, rows_to_broadcast, bound):
    monkeypatch.setattr(linededup, "_BROADCAST_ROWS", rows_to_broadcast)
    rng = random.Random(3)
    base = ["".join(rng.choice("abé日 ") for _ in range(rng.randint(0, 16))) for _ in range(40)]

    def change(x):
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3][: 5 + (bound > 1)])):
            k, c = rng.randint(0, len(x)), rng.choice("abé日")
            x = rng.choice([x[:k] + c + x[k:], x[:k] + x[k + 1 :], x[:k] + c + x[k + 1 :]])
        return x

    rows = [(rng.choice([d, d, 5, None]), None if d % 17 == 3 else "\n".join(change(rng.choice(base)) for _ in range(rng.randint(0, 6))), d, "x", d) for d in range(90)]
    df = table(rows, "doc_id long, text string, n_lines int, _uid string, row int")
    at_row = {r["row"]: r["u"] for r in place(df.drop("_uid"), "u").select("row", "u").collect()}
    got = {r["row"]: r for r in dedup_lines(df, min_chars=6, bound=bound).collect()}
    lines = sorted(((-(1 << 63) if r[0] is None else r[0], at_row[r[4]], k), x, r[4]) for r in rows for k, x in enumerate((r[1] or "").split("\n")) if x.strip(" \t\n\v\f\r"))
    gone = defaultdict(dict)
    for i, (at, x, row) in enumerate(lines):
        earlier = [y for _, y, _ in lines[:i]]
        if x in earlier:
            gone[row][at[2]] = "exact"
        elif any(min(len(x), len(y)) >= 6 and within(x, y, bound) for y in earlier):
            gone[row][at[2]] = "near"
    for r in rows:
        want = None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[r[4]])
        g = got[r[4]]
        assert (g["text"], g["doc_id"], g["_uid"], g["n_lines"]) == (want, r[0], "x", r[2])  # clashing columns stay
        assert (g["n_exact"], g["n_near"]) == (sum(v == "exact" for v in gone[r[4]].values()), sum(v == "near" for v in gone[r[4]].values()))


def test_line_dedup_bounds(table):
    """Two typos, a swap, and a chain of lines; lines over a block of variants; empty tables."""
    line = "the quick brown fox jumps over the lazy dog and runs away from there"
    swap, typos, far = line.replace("brown", "borwn"), line.replace("quick", "quikc").replace("away", "awy"), line.replace("lazy dog", "hazy fog!")
    long = "".join(random.Random(5).choice("abcdefgh ") for _ in range(200))
    rows = [(k, t, None, None, None) for k, t in enumerate([line, swap, typos, far, long, long[:100] + "ZZ" + long[100:], long[1:150] + long[151:], "", None, "one two"])]
    df = table(rows)
    kept = {b: {r["doc_id"] for r in dedup_lines(df, bound=b).collect() if r["n_lines"] and r["n_exact"] + r["n_near"] == 0} for b in (1, 2)}
    assert kept == {1: {0, 1, 2, 3, 4, 5, 6, 9}, 2: {0, 2, 3, 4, 9}}
    assert dedup_lines(df.where("doc_id < 0"), bound=2).collect() == []
    with pytest.raises(ValueError):
        dedup_lines(df, bound=-1)


def removed(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        m = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                m[k : k + length] = b"\1" * length
        out.append((len(b), sum(m), len(re.findall(b"\1+", bytes(m))), bytes(x for x, y in zip(b, m, strict=True) if not y)))
    return out


@pytest.mark.parametrize("length,bytes_to_broadcast", [(64, 1 << 20), (100, -1)])
def test_suffix_dedup(table, monkeypatch, length, bytes_to_broadcast):
    monkeypatch.setattr(suffixdedup, "_BROADCAST_BYTES", bytes_to_broadcast)
    monkeypatch.setattr(suffixdedup, "_BROADCAST_SPANS", bytes_to_broadcast)
    rng = random.Random(length)
    rows = documents(n=25)
    passage = "".join(rng.choice("abcdé ") for _ in range(150))
    for k in range(12):
        a, b = sorted(rng.sample(range(len(passage)), 2))
        rows.append((500 + k, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90))) + passage[a:b] + str(k), None, None, None))
    rows += [(600, "ab" * 200, None, None, None), (601, "abc" * 30, None, None, None)]
    got = remove_repeats(table(rows), length).collect()
    want = [(r[0], *x) for r, x in zip(rows, removed([r[1] for r in rows], length), strict=True)]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sorted(want)
    digest = remove_repeats(table(rows), length, digest=True).collect()
    assert sorted((r["doc_id"], r["kept_sha256"]) for r in digest) == sorted((w[0], hashlib.sha256(w[4]).hexdigest()) for w in want)


def test_columns():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 3, (60, 30)).astype(np.uint16)
    group = np.sort(rng.integers(0, 8, 60))
    group = np.cumsum(np.append(False, group[1:] != group[:-1]))
    got = column_repeats(symbols, group, 4)
    for i in range(60):
        for j in range(27):
            s = symbols[i, j : j + 4]
            same = [k for k in range(60) if k != i and group[k] == group[i] and (symbols[k, j : j + 4] == s).all()]
            assert got[i, j] == bool(same and (s > 0).all())


def components(rows, percent=75, k=5):
    sets = []
    for r in rows:
        w = W.findall((r[1] or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = defaultdict(list)
    for r, x in zip(rows, label, strict=True):
        least[x].append(r[0])
    return [(r[0], len(s), min(least[x])) for r, s, x in zip(rows, sets, label, strict=True)]


@pytest.mark.parametrize("rows_to_broadcast", [50_000, -1])
def test_jaccard(table, monkeypatch, rows_to_broadcast):
    monkeypatch.setattr(jaccard, "_BROADCAST_ROWS", rows_to_broadcast)
    rng = random.Random(9)
    rows = documents(n=30)
    for g in range(25):  # small and large sets with few or many changes
        w = [f"w{rng.randint(0, 60)}" for _ in range(rng.choice([6, 8, 12, 20, 40, 90]))]
        for k in range(rng.randint(1, 5)):
            v = w + [f"t{k}"] * rng.randint(0, 4) if rng.random() < 0.5 else w[rng.randint(0, 3) :]
            rows.append((1000 + g * 10 + k, " ".join(v), "en", "a", 0))
    placed = table(rows).withColumn("_uid", F.monotonically_increasing_id())
    got = near_duplicates(placed).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(components(rows))
    heads = [r["component_id"] for r in got if r["first"]]
    assert len(heads) == len(set(heads)) == len({r["component_id"] for r in got})


def test_resolve_and_prefix():
    rng = random.Random(2)
    for _ in range(60):
        pool = list(range(30))
        sets = [np.array(sorted(rng.sample(pool, rng.randint(3, 20))), np.uint64) for _ in range(rng.randint(1, 25))]
        for s in list(sets):
            sets.append(np.array(sorted({*s.tolist(), rng.randint(0, 40)} - {rng.randint(0, 40)} or {1}), np.uint64))
        got = resolve(sets, 75)
        want = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 75 * len(a | b) and want[i] != want[j]:
                    want = [want[j] if x == want[i] else x for x in want]
        assert len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))
    assert prefix(4, 75, 1) == 2 and prefix(3, 75, 1) == 1 and prefix(3, 75, 2) == 2
    assert boundary({}, 75) == 0 and 0 < boundary({10: 5, 500: 5}, 75) < 500


def test_empty_tables(table):
    empty = table([])
    assert repetition_quality(empty).count() == dedup_lines(empty).count() == remove_repeats(empty).count() == 0
    assert near_duplicates(empty.withColumn("_uid", F.monotonically_increasing_id())).count() == 0
