import random

import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, a clashing extra column."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    draw = random.Random(3)
    long = " ".join(draw.choices(words, k=60_000))
    rows = [(1, "plain text of a few words here", "x"), (1, "plain text of a few words here", "x"), (None, "no id here at all, none", "x"), (2, None, None), (3, "", "x"), (4, "  \t\n ", "x"), (5, long, "x"), (6, "Ünï ▁ “odd” \u0000 日本 text", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").selectExpr("doc_id", "text", "score", "1 as start", "2 as class", "3 as n", "4 as key", "5 as seed", "6 as hot", "7 as spans")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
