"""Skips the folder where the subpackage is away; small tables with awkward rows."""

import pytest

pytest.importorskip("conceptloom.llm")

WORDS = "the quick brown fox jumps over a lazy dog while seven old friends talk about rain and snow in spring".split()


def text(n: int, seed: int) -> str:
    return " ".join(f"{WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)]}{(i * seed) % 11 or ''}" for i in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and extra columns with clashing names."""
    rows = [(i, text(20 + i % 30, i), "en" if i % 2 else "de", f"s{i % 3}") for i in range(40)]
    rows += [(100, text(60, 3), "en", "s0"), (101, text(60, 3), "en", "s0"), (102, text(60, 3) + " x", None, None)]
    rows += [(103, None, "en", "s1"), (104, "", "en", "s1"), (105, " \t\n", "fr", None), (None, text(30, 5), "en", "s2"), (None, text(30, 5), "en", "s2")]
    rows += [(106, text(30_000, 9), "en", "s0"), (100, text(60, 3), "en", "s0"), (107, "ä Ö Á b İ", "de", "s1")]
    schema = "doc_id long, text string, lang string, source string, n_words int, fingerprint string, count long, key string, score double, copy int"
    return spark.createDataFrame([(*r, 1, "x", 2, "k", 0.5, 9) for r in rows], schema)
