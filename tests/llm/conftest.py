import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"word{i}" for i in range(60))
NEAR = PASSAGE.replace("word59", "other")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [tuple(r) for r in docs.orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and blank and very long texts, repeated rows and ids, ties."""
    long = " ".join(f"tall{i % 977} tree{i}" for i in range(40_000))
    return spark.createDataFrame(
        [
            (1, PASSAGE, "en", "a", 1), (2, PASSAGE, None, None, None), (2, PASSAGE, None, None, None), (3, NEAR, "de", "b", 2), (4, "", "en", "b", 0), (5, None, "en", "b", None),
            (6, " \t\n\x0b\x0c\r ", "en", "b", 7), (None, PASSAGE, "en", None, 1), (None, "alone here", "en", None, 1), (7, long, "en", "c", len(long)), (8, "Same line that repeats\nown line eight", None, "c", 3),
            (9, "  SAME line that repeats \nown line nine\n\n", "fr", "c", 3), (9, "another text under one id", "fr", "c", 3), (10, "\x00 nul \U0001f600 and éè", "fr", "c", 3),
        ],
        SCHEMA,
    )


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns under the names that operators use or add."""
    names = "id key bands signature h n label text_key hash lost n_lines n_dropped n_words n_removed kept base_failed lang_pred score rejected secrets class_id class_rows start end length ids".split()
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
