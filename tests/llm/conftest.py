import pytest

#: Texts that every operator on documents must take: null, empty, blank, short, repeated rows, a null id, a very long one, no ASCII.
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d e f g h"), (7, "a b c d e f g h"), (7, "a b c d e f g h"), (None, "no id here at all"),
    (8, "wort " * 9_000), (9, "Straße Ünïcode ſtark K   x y ΑΣ 日本語 🙂 token='abcdef'"), (10, "x" * 50_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts, with columns whose names clash with what the operators use inside."""
    names = "doc_id bigint, text string, node int, score string, secrets string, rate int, _n int, length string, kept string, label int, `_rows` int"
    return spark.createDataFrame([(i, t, 1, "s", "s", 1, 1, "l", "k", 1, 1) for i, t in ODD_TEXTS], names)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
