import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key string"


@pytest.fixture
def docs(spark):
    """Builds a documents table, with extra columns whose names operators use inside."""
    def make(rows):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s1")),
                 None if r[1] is None else len(r[1]), "x", "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, T.StructType([
            T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
            T.StructField("toxic", T.IntegerType())]))
    return make


ODD_ROWS = [(1, None), (2, ""), (3, " \n \n"), (None, "no id at all here"), (4, "same text here again ok"),
            (4, "same text here again ok"), (5, "word " * 30_000), (6, "\U0001F600 ünï ß"), (2 ** 62 + 1, "an id beyond exact floats")]
