import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long_text = "".join(f"word{i % 977} " for i in range(60_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", None, None, 3), (None, "same text here", "en", "b", 5), (None, "same text here", "en", "b", 5),
        (4, "same text here", "fr", None, 5), (5, "same text here", "fr", "c", None), (5, "same text here", "fr", "c", None), (6, long_text, "de", "a", 1), (7, long_text + "x", "de", "b", 1),
        (8, "one", "en", "a", 3), (9, "ONE", "en", "a", 3), (10, "123 456 !!", "en", "c", 3), (11, "élan vital naïve café", "fr", "c", 3), (12, "e\u0301tude \u3000 wide\u00a0space <|endoftext|> don't", "fr", "", 3),
    ]
    return spark.createDataFrame(rows, DOCUMENT)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with the names of results and of what operators might use inside."""
    from pyspark.sql import functions as F

    names = "id text_ fp component_id keep_id group_size kept size source_size target copies start length sequence_id offset shard slot law score held_out lang_pred node label __id __sha __size h".split()
    return odd.withColumns({n: F.lit(7) for n in names})
