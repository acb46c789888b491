"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> SparkSession:
    """Arrow batches of a bounded size, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return pin_splits(spark)


def pin_splits(spark: SparkSession) -> SparkSession:
    """Holds the number of splits of a scan that otherwise follows the cores registered at the moment, so that later jobs read as earlier ones."""
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(spark.sparkContext.defaultParallelism, 2)))
    return spark


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the value as text, modulo m; null counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % m


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one beside the warehouse where that is unset (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def shared(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Writes df to the shared folder, which cuts its lineage, gives up the shuffle files behind it, and returns what reads it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    written = df.checkpoint(eager=True)
    _release(df)
    return written


def _release(written: DataFrame) -> None:
    """Gives up the shuffle files of what has been written (with adaptive execution; else Spark's cleaner does so later)."""
    plan, cleaner = written._jdf.queryExecution().executedPlan(), written.sparkSession.sparkContext._jsc.sc().cleaner()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" and cleaner.isDefined():
        for k in list(plan.context().shuffleIds().keySet().toArray()):
            cleaner.get().doCleanupShuffle(k, True)


def _one_parquet_scan(docs: DataFrame) -> bool:
    """Whether each row of docs is one row of Parquet files: only projections and filters stand above a single scan."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def place(docs: DataFrame, name: str = "_uid") -> DataFrame:
    """docs with a long column that tells its rows apart and is the same in every job, whatever the splits and cores.

    Rows of Parquet files are known by file and row number: a hash of the file's name gives each file a start, so a table that is
    moved or read by another path keeps its places; where names repeat (folders of partitions), the path is hashed instead. The
    driver makes sure that the ranges of the files (two numbers a file) don't overlap. Any other rows are written once, with their numbers.
    """
    spark = docs.sparkSession
    if not _one_parquet_scan(docs):
        return shared(docs.withColumn(name, F.monotonically_increasing_id()), spark)
    meta = docs.metadataColumn("_metadata")
    for seed in range(17):
        start = F.xxhash64(meta["file_path"] if seed else meta["file_name"], F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))
        ranges = docs.select(start.alias("start"), meta["file_path"].alias("file"), meta["row_index"].alias("row")).groupBy("start", "file").agg((F.max("row") + 1).alias("n"))
        found = sorted((r["start"], r["n"]) for r in ranges.select("start", "n").collect())
        if all(a + n <= b for (a, n), (b, _) in zip(found[:-1], found[1:], strict=True)):
            return docs.withColumn(name, (start + meta["row_index"]).cast(LongType()))
    raise ValueError("the files' ranges of row numbers overlap")
