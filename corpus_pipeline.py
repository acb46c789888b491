"""A pipeline of operators of earshot.llm over the table documents.

Each stage takes what the stage before kept, as a table that is read, and returns the columns of documents; the last
returns tokens. ORACLE_SQL is None, as SQL can't express the trained language model of the first stage; tests
hold the stages against brute force.

Defined cases: documents with a null or empty text, or one without letters, go in the first stage, as their language is und; very long
texts pass whole; of equal rows one is left after line dedup (the others have no line left); an empty table gives an empty
result; ties go to the smaller id, then to the place in the table; further columns pass through the stages, whatever their
names (columns that a stage adds for itself get names that are free), and n_chars is brought up to date where there is one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm.bpe import bpe_corpus, default_vocabulary
from earshot.llm.common import crc_mod, place, shared_dir, tune
from earshot.llm.jaccard import near_duplicates
from earshot.llm.langid import identify, train
from earshot.llm.linededup import dedup_lines
from earshot.llm.mixing import mix_sources, word_count

#: Documents whose language is less probable than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names with so many underscores in front that docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    longest = max([0, *(len(c) for c in taken)])
    return tuple(n if n not in taken else "_" * longest + n for n in names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose language is recognised."""
    tune(spark)
    lang, score = free(docs, "found_lang", "found_score")
    langs, table = train(docs.where(crc_mod("doc_id", 4) != 2))
    found = identify(docs, langs, table, out=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; documents of which no line is left go."""
    tune(spark)
    n, exact, near = free(docs, "lines_all", "lines_exact", "lines_near")
    kept = dedup_lines(docs, counts=(n, exact, near)).where((F.col(n) == 0) | (F.col(exact) + F.col(near) < F.col(n)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest id."""
    tune(spark)
    (uid,) = free(docs, "place_of_row")
    placed = place(docs, uid)
    first = near_duplicates(placed, uid=uid).where("first").select(F.col("_uid").alias(uid))
    return placed.join(first, uid, "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings sources to their target weights; a document that is taken twice has two rows."""
    tune(spark)
    uid, copies, copy = free(docs, "place_of_row", "copies_taken", "copy_number")
    placed = place(docs, uid)
    mixed = mix_sources(placed, word_count("text"), F.array("source"), keep=(uid,)).where("copies > 0").select(uid, F.col("copies").cast("int").alias(copies))
    both = placed.join(mixed, uid)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes the texts: doc_id, lang, source, n_tokens, digests of ids and decoded text, ids."""
    tune(spark)
    return bpe_corpus(docs.select("doc_id", "text", "lang", "source"), default_vocabulary(), keep=("lang", "source"))


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("source mixing", mix), ("BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet in the shared folder and read again."""
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{k}")
            docs = spark.read.parquet(f"{top}/{k}")
    return docs
