"""Running error rates over a stream of result rows: counts are associative, so the stream's groups equal the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from earshot.functions.text import NormalizerConfig
from earshot.operators.aggregate import pooled
from earshot.operators.align import score
from earshot.sources.manifest import RESULT


def results_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows from the Parquet files that arrive in a folder."""
    return spark.readStream.schema(RESULT).parquet(folder)


def live_wer(stream: DataFrame, normalizer: NormalizerConfig = NormalizerConfig()) -> DataFrame:
    return pooled(score(stream, normalizer), "provider", "condition")


def start_live_wer(stream: DataFrame, name: str, checkpoint: str, normalizer: NormalizerConfig = NormalizerConfig()) -> StreamingQuery:
    """Keeps the in-memory table `name` complete."""
    return live_wer(stream, normalizer).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
