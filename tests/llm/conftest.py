import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHES = "row rep digest block blocks cell group n score kept keep_id sampled topic probability weight n_tokens __digest __hash __tokens __topic words hits label quality own anchor".split()


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfghjklm')}{r.choice('aeiou')}{r.choice('nprst')}{r.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) or longer rows; clashes adds columns."""

    def make(rows, clashes=False):
        full = [(*r, *("en", "s0", len(r[1] or ""))[len(r) - 2 :]) for r in rows]
        if not clashes:
            return spark.createDataFrame(full, SCHEMA)
        return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in full], SCHEMA + "".join(f", {c} string" for c in CLASHES))

    return make


@pytest.fixture(scope="session")
def odd():
    """Null ids and texts, empty and long texts, repeated rows and ids."""
    long = prose("long", 30_000)
    return [(None, None), (None, "null id"), (1, None), (2, ""), (3, " \t\n "), (4, "!?"), (5, "one two"), (5, "one two"), (6, "one  two"), (7, long), (8, long), (8, "other text of the same id"), (9, "É" * 50), (10, "a" * 3000)]
