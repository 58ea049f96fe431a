import random

import pytest

SYLLABLES = "ka lo mi ne tu ra vo shi pe dun gar fel tos wim bri".split()


@pytest.fixture
def prose():
    """Invented texts: ``prose(seed, words)``."""

    def make(seed, words):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))

    return make


@pytest.fixture
def documents(spark):
    """A ``documents`` table from ``(doc_id, text)`` rows, with further columns whose names the operators use themselves."""

    def make(rows):
        more = ", ".join(f"'x' AS {c}" for c in ("n", "node", "key", "words", "score", "kept", "shard", "seed", "tokens", "page_id", "row_key", "_words", "_row"))
        df = spark.createDataFrame(list(rows), "doc_id bigint, text string")
        return df.selectExpr("*", "'en' AS lang", "'src' AS source", "length(text) AS n_chars", *more.split(", "))

    return make


ODD = (None, "", "   ", "\n\t \r\n", "word", "Word", "a b c", "ümläut ß 漢字 😀 é", "x" * 5000, "\x00\x01 y", "tab\tsep\x0bvt\x0cff", "nbsp joined  em")


@pytest.fixture
def odd():
    return ODD
