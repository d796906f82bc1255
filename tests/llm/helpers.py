"""Small tables that hold the hard cases: nulls, empties, ties, repeats, clashing columns."""

import random

WORDS = [f"w{i}" for i in range(800)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(seed=1, n=40):
    """(doc_id, text) with nulls in both, empty, blank and long texts, and repeated rows."""
    rng = random.Random(seed)
    out = [(i, text(rng, rng.randint(0, 60))) for i in range(n)]
    out += [(100, None), (101, None), (102, ""), (103, " \n\t "), (104, "a"), (None, text(rng, 30)), (None, None), (105, text(rng, 9000)), out[3], out[3], (106, out[4][1])]
    return out


SCHEMA = "doc_id long, text string"


def table(spark, seed=1, n=40):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
