import random

import pytest

#: Extra columns whose names clash with those that the operators use inside.
CLASH = "row long, fp long, start long, score double, text_hash long, lines int, root string, held_out int"
PHRASE = "a shared passage of quite a few plain words that several documents hold in the very same order as it stands here"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and separator-only texts, repeated rows and ids, ties, odd letters, special strings, a long text."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = body(30_000)
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, "One Two"), (4, "one two"), (5, body(50) + " " + PHRASE + " " + body(20)), (6, PHRASE), (7, PHRASE.upper() + "!"), (8, long), (9, long + " end"),
             (10, "naïve Ünïcode 漢字 ½ <|endoftext|> it's'll ''s"), (11, body(12)), (11, body(12)), (12, "same row"), (12, "same row"), (None, "no id"), (13, "\n".join([PHRASE, "x", PHRASE]))]
    rows = [(i, t, "en", "src", len(t or ""), 1, 2, 3, 0.5, 4, 5, "r", 6) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, edge_docs):
    return spark.createDataFrame([], edge_docs.schema)
