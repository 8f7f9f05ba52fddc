import pytest

#: Extra columns whose names clash with those that the operators make.
EXTRA = ["size", "kept", "key", "text_sha256", "score", "term", "n_tokens", "_id", "bucket", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def rows(pairs):
    return [(i, t, "en", s, None if t is None else len(t), *["x"] * len(EXTRA)) for i, t, s in pairs]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, odd characters and a null id."""
    long = " ".join(f"word{i % 977} and" for i in range(20_000))
    texts = [None, "", "  \n\t ", "a", "A", "a", long, long + " end", "İstanbul ſ é ŉ", "日本語\n\n\n", "x" * 5000, "one two three four", "One  two three\tfour", "<|endoftext|> it's 'S"]
    pairs = [(i, t, (None, "b", "a", "")[i % 4]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows([*pairs, (3, "a", "b"), (None, "null id", None), (None, None, "a")]), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
