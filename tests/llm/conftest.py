import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeats, a long text, and columns of clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "the cat sat on the mat and then it ran away home", "en", "a", 5), (2, "the cat sat on the mat and then it ran away home", "en", None, 5), (3, None, None, "b", None), (4, "", "en", "a", 0), (5, " \t\n", "fr", "a", 3)]
    rows += [(6, long, "en", "c", 9), (6, long, "en", "c", 9), (None, "one two", "en", "a", 1), (8, "x" * 5000, None, None, 1), (9, "a b c", "en", "a", 1), (10, "A B C", "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"score": F.lit("mine"), "kept": F.lit(1), "size": F.lit(2), "target": F.lit(3), "spans": F.lit(4), "toxicity_": F.lit(5)})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
