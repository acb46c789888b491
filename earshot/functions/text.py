"""Text normalisation as Column builders, in a fixed order of steps.

NFKC is the one step that Spark has no function for; it runs in an Arrow UDF that is handed only the texts with
characters beyond ASCII (others pass as null). Everything else is built in.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, fields
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.types import TEXT

# Replacements in their order, number words, fillers
CONTRACTIONS = [("can't", "cannot"), ("won't", "will not"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would"), ("'m", " am"), ("let's", "let us"), ("it's", "it is")]
ONES = {"zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
FILLERS = ["uh", "um", "erm", "mm", "hmm", "uhh", "ah"]

_NUMBER_WORDS = "|".join(sorted([*ONES, *TENS, "hundred", "thousand"], key=len, reverse=True))
_RUN = rf"(?<![^ ])(?:{_NUMBER_WORDS})(?: (?:{_NUMBER_WORDS}))*(?![^ ])"
_CUT = "\u0001"


@dataclass(frozen=True)
class NormalizerConfig:
    """Which steps run; strip_filler is off as fillers are speech."""

    lowercase: bool = True
    strip_punctuation: bool = True
    expand_contractions: bool = True
    spell_out_numbers: bool = True
    collapse_whitespace: bool = True
    strip_filler: bool = False

    def describe(self) -> str:
        return ", ".join(f.name for f in fields(self) if getattr(self, f.name)) or "none"


@F.pandas_udf(TEXT)
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def expand_contractions(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), CONTRACTIONS, text)


def strip_punctuation(text: Column) -> Column:
    """Every character but letters, numbers, underscores, apostrophes and white space becomes a space."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_\s']", " ")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s\p{Z}\x1c-\x1f\x85]+"), lambda w: w != "")


def strip_fillers(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(FILLERS))


def _lookup(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def number_of(run: Column) -> Column:
    """The digits for a run of number words, or null if it has no value.

    Two or more bare digits are read out one by one; other runs are summed, with hundred and thousand as factors. A value
    of more than 38 digits counts as none.
    """
    digits, units = _lookup({k: v for k, v in ONES.items() if v < 10}), _lookup(ONES | TENS)
    bare = (F.size(run) >= 2) & F.forall(run, lambda w: F.map_contains_key(digits, w))
    spelled = F.array_join(F.transform(run, lambda w: F.element_at(digits, w).cast("string")), "")
    big = "decimal(38,0)"
    zero = F.struct(F.lit(0).cast(big).alias("total"), F.lit(0).cast(big).alias("part"), F.lit(False).alias("seen"), F.lit(True).alias("ok"))

    def step(acc: Column, word: Column) -> Column:
        value = F.try_element_at(units, word)
        at_least_one = F.greatest(acc["part"], F.lit(1).cast(big))
        hundred, thousand = (word == "hundred") & acc["seen"], (word == "thousand") & acc["seen"]
        part = F.when(value.isNotNull(), F.try_add(acc["part"], value.cast(big))).when(hundred, F.try_multiply(at_least_one, F.lit(100).cast("decimal(3,0)"))).when(thousand, F.lit(0).cast(big)).otherwise(acc["part"])
        total = F.when(thousand, F.try_add(acc["total"], F.try_multiply(at_least_one, F.lit(1000).cast("decimal(4,0)")))).otherwise(acc["total"])
        return F.struct(total.cast(big).alias("total"), part.cast(big).alias("part"), (acc["seen"] | value.isNotNull()).alias("seen"), (acc["ok"] & (value.isNotNull() | hundred | thousand) & part.isNotNull() & total.isNotNull()).alias("ok"))

    summed = F.aggregate(run, zero, step, lambda acc: F.when(acc["ok"] & acc["seen"], F.try_add(acc["total"], acc["part"]).cast("string")))
    return F.when(bare, spelled).otherwise(summed)


def numbers_to_digits(text: Column) -> Column:
    """Replaces runs of number words in a text of words parted by single spaces.

    The text is cut around the runs, so each run is folded by itself and the cost is linear in the text.
    """
    pieces = F.split(F.regexp_replace(text, _RUN, f"{_CUT}$0{_CUT}"), _CUT)
    done = F.transform(pieces, lambda p, k: F.when(k % 2 == 1, F.coalesce(number_of(F.split(p, " ")), p)).otherwise(p))
    return F.array_join(done, "")


def normalize(text: Column, cfg: NormalizerConfig = NormalizerConfig(), unicode: bool = True) -> Column:
    """The normalised text; null becomes the empty text. unicode=False skips NFKC for texts known to be stable."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    if unicode:
        t = nfkc(t)
    if cfg.lowercase:
        t = F.lower(t)
    if cfg.expand_contractions:
        t = expand_contractions(t)
    if cfg.strip_punctuation:
        t = strip_punctuation(t)
    words = split_words(t)  # parts at white space, so collapsing it changes nothing further
    if cfg.strip_filler:
        words = strip_fillers(words)
    t = F.array_join(words, " ")
    return numbers_to_digits(t) if cfg.spell_out_numbers else t


def word_tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def char_tokens(normalized: Column) -> Column:
    return F.filter(F.split(F.replace(normalized, F.lit(" "), F.lit("")), ""), lambda c: c != "")
