"""Small documents with awkward cases: nulls, empty and long texts, copies, near copies, repeated rows and null columns."""

import random

WORDS = ["the", "of", "and", "überall", "straße", "niño", "garçon", "stone", "river", "cloud", "lamp", "table", "ten", "red", "blue", "Green", "sky"]


def words(rng, n):
    return [rng.choice(WORDS) + (str(rng.randint(0, 400)) if rng.random() < 0.5 else "") for _ in range(n)]


def documents(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = "\n".join(" ".join(words(rng, rng.randint(1, 30))) for _ in range(rng.randint(1, 5)))
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "a", None]), len(text)))
    base = " ".join(words(rng, 150))
    rows.append((n, base, "en", "a", len(base)))
    for k in range(1, 8):
        w = base.split(" ")
        for _ in range(k):
            w[rng.randrange(len(w))] = "changed"
        rows.append((n + k, " ".join(w), "en", "b", 0))
    rows += [(n + 20, base, "en", "c", 0), (n + 20, base, "en", "c", 0), (n + 21, None, None, None, None), (n + 22, "", "en", None, 0), (n + 23, " \n\t ", "en", "a", 0), (n + 24, "one two", "en", "a", 0), (n + 25, "one two", "de", "a", 0)]
    long = " ".join(words(rng, 6000)) + " " + " ".join(["again and again"] * 400)
    rows += [(n + 26, long, "en", "z", 0), (n + 27, "x" * 5000, "en", "z", 0), (n + 28, "漢字 😀 é" * 60, "xx", "z", 0)]
    rng.shuffle(rows)
    return rows
