import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("score", T.StringType()), T.StructField("size", T.StringType()), T.StructField("fp", T.StringType()),
    T.StructField("shard", T.StringType()), T.StructField("row_id", T.StringType()), T.StructField("key", T.StringType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, parts=3):
        """rows: (doc_id, text[, lang[, source]])"""
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, *[None] * (4 - len(r)))[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), "x", None, "y", "z", "w", "v"))
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return make


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 997}" for i in range(40_000))
    return [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "word", None, "b"), (5, "same text here", "en", None),
            (6, "same text here", "en", "b"), (6, "same text here", "en", "b"), (None, "no id at all", "en", "b"), (None, None, None, None),
            (7, long, "en", "a"), (8, "é ü 漢字 \U0001F600 \x00 x", "fr", "c"), (9, "A" * 70_000, "en", "c"), (10, "1234 !!! ???", "en", "a")]
