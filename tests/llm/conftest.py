import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and odd texts, repeated rows, equal ids, and columns that operators use themselves."""
    prose = "the quick brown fox jumps over the lazy dog and runs far away from here to there " * 5
    rows = [
        (1, prose, "en", "a", len(prose)), (2, prose, "en", "a", len(prose)), (2, prose, "en", "a", len(prose)),
        (3, None, None, None, None), (None, "kein Text ohne Wort", "de", "b", 19), (None, None, None, None, None),
        (4, "", "en", None, 0), (5, " \t\n ", "fr", "b", 4), (6, "w" * 300_000, "fr", "c", 300_000), (7, "一 二 三 é ß 😀", None, "c", 13),
        (8, "<|im_end|> \\s <\\| token: abcdefgh12", "es", "a", 36), (9, "x", "en", "b", 1),
        (10, " ".join(f"w{i}" for i in range(60_000)), "en", "a", 408_889),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("fingerprint", "row", "size", "key", "label", "id", "piece", "length", "score", "lang_pred", "part", "rank", "kept", "spans",
                 "_id", "_hash", "_text_hash", "_fingerprint", "_row", "_text", "_held"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
