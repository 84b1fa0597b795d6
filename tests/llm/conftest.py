import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Edge rows: nulls in every column, empty and very long texts, ties and repeated rows.
EDGES = [
    (1, "one two three four five six", "en", "a", 27), (2, "", "en", "a", 0), (3, None, None, None, None), (None, "no id here at all", "en", "b", 17), (4, "word " * 60_000, "en", "b", 300_000),
    (5, "one two three four five six", "en", "a", 27), (6, "one two three four five six", "en", None, 27), (6, "one two three four five six", "en", None, 27), (7, "x" * 200_000, "en", "c", 200_000), (8, " \t\n ", "en", "c", 4), (9, "é日本 ß  <|endoftext|> ▁", "de", "c", 20),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Edge documents with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, DOCUMENT)
    for c in ("score", "size", "length", "fp", "node", "label", "taken", "sequence_id"):
        df = df.withColumn(c, F.lit("own"))
    return df


@pytest.fixture(scope="session")
def none(edges):
    return edges.limit(0)
