import pytest
from pyspark.sql import types as T

#: Documents with columns that clash with names the operators use themselves.
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("component_id", T.LongType()),
        T.StructField("row", T.StringType()),
        T.StructField("keys", T.StringType()),
    ]
)


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) pairs."""

    def build(pairs, parts=3):
        rows = [(i, t, None if t is None else len(t), "k", None, "r", None) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(parts)

    return build


ODD = [(None, None), (None, "no id at all"), (7, ""), (7, ""), (8, None), (9, " \t\n\x0b\x0c\r "), (10, "é" * 3 + "\n\n"), (11, "\x00\x1f  x")]


@pytest.fixture
def odd():
    """Nulls, empties, repeated rows."""
    return list(ODD)


@pytest.fixture
def files():
    import public_tokenizers

    return public_tokenizers.path
