import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

CLASHING = ("id", "key", "version", "_text", "score", "n", "rep", "gone", "start", "block", "sha", "root", "_words", "vote", "new", "other", "n_tokens")
PASSAGE = " ".join(f"shared{i}" for i in range(70))


def odd_rows():
    """(id, text): NULLs, empties, a very long text, copies, ties, near copies, shared passages."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(4000)]
    base = " ".join(words[:120])
    edited = base.split()
    edited[60] = "changed"
    rows = [
        (1, base),
        (2, base.upper()),
        (2, base.upper()),  # a repeated row
        (3, " ".join(edited)),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "Two Words"),
        (8, "two words"),
        (9, "a" * 900),
        (10, " ".join(words) + " " + PASSAGE + " end."),
        (11, "é" * 150 + " " + PASSAGE),
        (12, "Start, of: " + PASSAGE + " " + " ".join(words[500:560])),
        (13, "x y " * 300),
        (14, "\x00 odd   signs \U0001f600 " * 3),
        (15, " ".join(f"long{i}" for i in range(30000))),
        (None, base),
        (None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names operators might use."""
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    data = [(i, t, None, None, None, *["x"] * len(CLASHING)) for i, t in odd_rows()]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    return spark.createDataFrame(data, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    """A table without rows."""
    return odd.limit(0)


def same(got, want):
    """Equal as multisets, NULL ids included."""
    assert sorted(map(repr, got)) == sorted(map(repr, want))
