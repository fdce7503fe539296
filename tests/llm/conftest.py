import pytest

#: doc_id, text, lang, source, n_chars, and columns whose names clash with what operators use inside.
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "Mail bob@example.org or call +44 20 7946 0958 now, card 4111 1111 1111 1111, host 10.0.0.1.", "en", "b"),
    (2, None, "en", "a"), (3, "", None, "a"), (4, "   \n\t ", "de", None), (None, "no ident here at all", "en", "a"), (5, "One", None, None),
    (6, "the same text twice over and over again for ever", "en", "a"), (7, "the same text twice over and over again for ever", "en", "b"), (7, "the same text twice over and over again for ever", "en", "b"),
    (8, LONG, "en", "a"), (9, LONG + " tail", "fr", "c"), (10, "x" * 50_000, "en", "c"), (11, "1" * 20_000 + "@" * 3 + "." * 40, "en", "c"), (12, "Ünïcödé \U0001f600 日本 <|endoftext|> ＡΣ\x1c \x85x", "de", "ü"),
    (13, "line\nline\nline\n\nother line\nline", "en", "a"), (14, "a b c d e f g h i " * 9, "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    data = [(*r, None if r[1] is None else len(r[1]), 1, "x", "y", 2.0, 7) for r in ROWS]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, shard int, _text string, label string, score double, _id long").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
