import pytest


@pytest.fixture
def table(spark):
    """Documents with two columns that operators do not read."""

    def make(rows, schema="doc_id bigint, text string"):
        from pyspark.sql import functions as F

        return spark.createDataFrame(rows, schema).withColumns({"score": F.lit("x"), "ids": F.lit(1)})

    return make
