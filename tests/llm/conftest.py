import pytest

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "a null id has words too, as many as it likes"),
    (5, "ÀÉ   İstanbul ΣΑΣ don't 12 34's"), (6, "word " * 30_000), (7, "x" * 20_000), (8, "<|endoftext|> \x1c\x1d end"), (-9, "minus nine"), (10, "é \U0001f600 ﬁ"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names
    operators use inside."""
    rows = [(i, t, "src", 7.0, "x", i) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept double, a string, start long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
