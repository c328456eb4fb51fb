from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, source string, rank int, score double"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with some outputs' names."""

    def make(texts):
        rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "s", 1, 0.5) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Nulls, empty texts, copies, near copies, shared passages, odd characters and one long text."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, line = prose(60), prose(12)
    long = prose(4000)
    near = long.split()
    near[7] = "changed"
    texts = [None, "", " \n\t ", "One", "one", prose(30), passage, f"{prose(9)} {passage} {prose(5)}", f"{line}\n{prose(40)}\n{line}", f"{line} x\n{passage}", long, long, " ".join(near)]
    texts += ["aé  ü  ń \x1c 日本語 😀😀", "x" * 700, "ab" * 400, f"{prose(20)}  {prose(20)}\r\n\r\n{prose(3)}", passage.upper(), passage]
    return texts
