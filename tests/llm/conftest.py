import pytest

#: Empty and null texts, repeated rows, ties, copies, short and long texts, several scripts.
LONG = " ".join(f"word{i % 997} token{i % 31}" for i in range(6_000))
TEXTS = [None, "", " \n\t", "One", "one two three four", "Same text here for all of us to see", "Same text here for all of us to see", "same TEXT here for all of us to see", "été naïve 漢字 🙂 नमस्ते", LONG, LONG + " end", "a" * 3000, "!!! ???", "x\x00y\x1cz\x85"]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls anywhere, repeated ids, and columns whose names operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None), (5, TEXTS[5], "en", "s", 1), (5, "another text of the same id", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'f' as fp", "'i' as ids", "'r' as row", "1 as size", "'s' as secrets", "'k' as kept", "2 as score", "'l' as language", "3 as rank")


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
