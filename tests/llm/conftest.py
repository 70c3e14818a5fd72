import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path[:0] = [str(Path(__file__).parent)]

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Null ids, texts and sources, empty and long texts, ties and repeated rows, white space of all kinds, marks.
ODD_TEXTS = [
    None, "", " ", "\n\n", "one", "one two", "Ein Straße im Nebel\nund noch eine Zeile", "a b c a b c a b c", "same line\nsame line\nother", "x" * 5000, "tab\tvt\x0bff\x0ccr\r end",
    " wide space ", "emoji \U0001f600 here # $ %", "word " * 3000, "<|endoftext|> </turn> ### \\ ok", "\x1c\x1d odd", "nul\x00in", "Ωmega ΣΑΣ é é",
]


def odd_rows():
    rows = [(i * 3 - 5, t, "en", ("web", "books", None)[i % 3], len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    return rows + [rows[6], rows[6], (None, "no id here", "en", "web", 10), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def widened(df):
    """With columns whose names clash with the operators' own and with each other but for case."""
    names = ["TEXT", "rep", "hash", "size", "stats", "key", "part", "lost", "copies", "Doc_ID"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def clashing(odd):
    return widened(odd)
