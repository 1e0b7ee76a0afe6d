import random

import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def edge_rows():
    """Nulls, blanks, a very long text, repeated rows and a repeated doc_id."""
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, LONG), (6, "alpha beta gamma delta epsilon"), (6, "alpha beta gamma delta epsilon"), (7, "alpha beta gamma delta epsilon"), (None, "alpha beta gamma delta epsilon"), (8, "Übung \U0001f600 macht den Meister. <|endoftext|>")]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows with further columns whose names clash with those of the operators."""
    rows = [(d, t, "x", 1, True, "y") for d, t in edge_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, shard int, kept boolean, row string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def copies():
    """(doc_id, text): groups of near copies of different lengths and rates of change, and unrelated texts."""
    rng = random.Random(5)
    words = [f"t{i}" for i in range(3_000)]
    out, doc = [], 0
    for size in (12, 60, 150, 900, 3_000):
        base = [rng.choice(words) for _ in range(size)]
        for changes in (0, 0, 1, 2, size // 40, size // 25, size // 15, size // 6):
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(size)] = rng.choice(words)
            out.append((doc, " ".join(w)))
            doc += 1
        out.append((doc, " ".join(rng.choice(words) for _ in range(size))))
        doc += 1
    return out
