"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .bpe import bpe_digests, default_vocabulary
from .common import read, tune
from .jaccard import near_duplicates
from .langid import language_id
from .linededup import dedup_lines
from .lm import lm_scores
from .mixing import mix_sources, word_count
from .ranking import quality_ranking
from .repetition import repetition_quality
from .suffixdedup import remove_repeats
from .topk import quantised, top_k

#: Passages of more than 50 words are shorter than 400 bytes as often as not; what repeats from this length on is told beside what is removed.
PASSAGE_BYTES = 256


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return quality_ranking(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    kept = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_exact", "n_near", F.length("text").alias("kept_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, quantised("embedding"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"), word_count("text"), F.array("source"))
    info = mixed.source_info  # a row for each source
    return mixed.join(F.broadcast(info), mixed["sources"][0].eqNullSafe(info["source"])).select("doc_id", "source", "size", "source_size", "target", "taken")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return remove_repeats(read(spark, sf_dir, "documents"), digest=True, passage=PASSAGE_BYTES)


def op5_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    tune(spark)
    return bpe_digests(read(spark, sf_dir, "documents"), vocabulary or default_vocabulary())


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return lm_scores(read(spark, sf_dir, "documents"))


def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return repetition_quality(read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return language_id(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_ranking, op2_line_dedup, op3_exact_top_k, op4_suffix_dedup, op5_bpe, op6_mix_sources, op7_lm_scores, op8_repetition_rules, op9_jaccard_join, op10_language_id)}
ORACLE_SQL = {"op2_line_dedup": oracle.LINES, "op3_exact_top_k": oracle.TOP_K, "op4_suffix_dedup": oracle.SUFFIXES, "op8_repetition_rules": oracle.REPETITION, "op9_jaccard_join": oracle.JACCARD}
