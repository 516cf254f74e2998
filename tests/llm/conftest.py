from __future__ import annotations

import random

import pytest

SYLLABLES = "ba ko mi ten ru sal vor pel dun gri tha lo me nis qua zed".split()


@pytest.fixture(scope="session")
def prose():
    """Made-up words, n of them, from a seed."""
    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def hard_rows(prose):
    """Documents with every awkward case: null, empty, blank, short, very long, repeated, without an id."""
    base = prose(1, 120)
    words = base.split()
    rows = [
        (0, base, "aa", "s0"),
        (1, None, "aa", "s0"),
        (2, "", None, None),
        (3, " \n\t ", "bb", "s1"),
        (4, "one Two", "bb", "s1"),
        (5, base, "aa", "s0"),
        (6, " ".join([*words[:60], "changed", *words[61:]]), "aa", "s2"),
        (7, prose(2, 6000), "bb", "s2"),
        (8, prose(3, 40) + "\n" + " ".join(words[20:60]) + "\n" + prose(4, 40), "bb", "s2"),
        (9, "a " * 900, None, "s1"),
        (10, "Éa ñu 漢字 🙂 " * 30, "cc", "s1"),
        (11, prose(5, 5), "cc", "s1"),
        (12, base.upper(), "aa", "s0"),
        (12, base.upper(), "aa", "s0"),
        (None, prose(6, 50), "aa", "s0"),
    ]
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """The same as a frame, with columns named like results of the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hard_rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in ("score", "n_chars", "fingerprint", "kept", "tokens", "stretch", "sequence_id")}).repartition(3)


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.limit(0)
