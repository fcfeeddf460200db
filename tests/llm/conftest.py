from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(40_000))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the old bear in the wood today"
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, "  " + base.replace(" ", "\n") + " ", None, "b"),
        (4, base.replace("bear", "wolf"), "en", None),
        (5, base.upper(), "en", "b"),
        (6, None, "en", "a"),
        (7, "", None, None),
        (8, " \t\n", "de", "b"),
        (9, LONG, "en", "a"),
        (10, LONG + " more", "en", "a"),
        (11, "kurz und gut", "de", "c"),
        (12, "12 34 %%% !!!", "de", "c"),
        (13, "x", "en", "c"),
        (None, "a row without a name is a row like any other row here", "en", "a"),
        (14, "ein haus am see mit einem garten und vielen alten bäumen steht dort", "de", "b"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    extra = "42L v, 'q' unit, 7 shard, 'x' block, 'y' print, 1 n, 2 part, 3 slot, 'z' sha, 5 tokens, 6 before, 8 cell"
    return spark.createDataFrame(rows, schema).selectExpr("*", *(f"{x}" for x in extra.split(", ")))


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")
