import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a table like ``documents``, with an extra column whose name clashes with those the operators use."""

    def make(rows):
        data = [(i, t, "en", "s", None if t is None else len(t), 1) for i, t in rows]
        schema = T.StructType([*T._parse_datatype_string(DOCS).fields, T.StructField("n_tokens", T.IntegerType())])
        return spark.createDataFrame(data, schema)

    return make
