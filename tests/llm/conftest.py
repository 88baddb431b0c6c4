import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne", "su") for b in ("r", "t", "v", "nd") for c in ("a", "e", "ing", "on")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def tricky_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, copies, near copies, shared passages, repeated rows."""
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, " ".join(near), "en", "b", 1),
        (4, f"{prose(4, 30)} {passage}\t{prose(5, 30)}", "de", "b", 1),
        (5, f"{prose(6, 15)}\n{passage}  {passage}", "de", None, None),
        (6, None, "en", "a", None),
        (7, "", None, "a", 0),
        (8, " \t\n", "fr", "c", 3),
        (9, "one", "fr", "c", 3),
        (10, "one two three four", None, "c", 3),
        (11, "one two three four", "fr", "", 3),
        (12, prose(12, 20_000), "en", "a", 9),
        (12, prose(13, 50), "en", "a", 9),
        (None, prose(14, 80), None, None, None),
        (None, prose(14, 80), None, None, None),
        (15, prose(15, 40), "en", "a", 1),
        (15, prose(15, 40), "en", "a", 1),
        (16, "12 ... !!! 34", "en", "d", 1),
        (17, "é́ 日本語 😀 naïve word \x0b end", "fr", "d", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(tricky_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(tricky):
    """The same rows with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("size", "score", "node", "key", "n", "start", "row", "kept", "lang_pred", "class_id", "spans", "h", "block", "label", "kind", "value", "end")
    return tricky.withColumns({n: F.lit("x") for n in names})
