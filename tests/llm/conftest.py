import random

import pytest

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo zu".split() for b in "n r s t l m".split()]


@pytest.fixture(scope="session")
def prose():
    """Texts of random words; the same seed gives the same text."""

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(["", "", "ing", "er"]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (id, text) pairs, with the table's other columns and one of a clashing name."""

    def make(rows, clash: str | None = None):
        data = [(i, t, "en", f"src{(i or 0) % 5}", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", f"'x' AS {clash}") if clash else df

    return make
