import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark, tmp_path):
    """Writes rows as a Parquet table in a fresh folder and returns what reads it."""
    from earshot.llm.common import tune

    tune(spark)
    count = iter(range(100))

    def make(rows, schema=DOCS, parts=2, name=None):
        path = str(tmp_path / (name or f"t{next(count)}.parquet"))
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make
