from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

# Names that the operators use inside: a table may have them too.
CLASHING = "text2 string, sha int, row int, block int, fp int, bucket int, owner int, kept int, key int, n int, node int, copy int, h int, __copy int"


@pytest.fixture(scope="session")
def clash(spark):
    """Rows (id, text) as a table with columns of clashing names."""

    def make(rows, ids="doc_id", text="text"):
        names = [c.split()[0] for c in CLASHING.split(", ")]
        extra = [None if n == "text2" else 7 for n in names]
        return spark.createDataFrame([(*r, *extra) for r in rows], f"{ids} bigint, {text} string, {CLASHING}").repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    """Documents from a small vocabulary, so that runs of words and lines repeat."""

    def make(n, seed, words="a b c d é Zz"):
        rng = random.Random(seed)
        vocabulary = words.split()
        passages = [" ".join(rng.choices(vocabulary, k=rng.randint(4, 14))) for _ in range(8)]
        rows = []
        for i in range(n):
            parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 7))]
            rows.append((i, rng.choice(["\n", " ", " \n\n", "\t"]).join(parts)))
        return rows

    return make


EDGES = [
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "One Two three"),
    (5, "one two THREE"),
    (6, "ÉCOLE École"),
    (7, "école École"),
    (8, "w " * 30_000),
    (9, "x" * 200_000),
    (10, "\n".join(f"line {i % 50}" for i in range(4_000))),
]
