import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text, and extra columns."""
    long = " ".join(f"word{i % 977} and" for i in range(60_000))
    texts = [None, "", " \t\n ", "one", "two words", "Same line here, long enough.\nother", "Same line here, long enough.\nother", long, "ünï \u00a0 ﬁx\n\n漢字 かな"]
    rows = [(i, t, "en", f"s{i}", 7, 1) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s5", 7, 1), (None, "Same line here, long enough.", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, score int")
