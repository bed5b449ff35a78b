"""Shared edge cases for the corpus operators."""

from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def edge_rows() -> list[tuple]:
    """(doc_id, text): nulls, empties, blanks, repeats, ties, one very long."""
    base = ("the quick brown fox jumps over the lazy dog while the small cat sleeps near the warm "
            "stove and nobody in the old house says a single word about it")
    near = base.replace("stove", "oven")
    return [
        (1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n "),
        (7, "one"), (8, "one two three"), (None, base), (None, None), (9, LONG), (10, LONG + " z"),
        (11, "x" * 50_000), (12, base + " " + base), (13, "für naïve Öl ça ñu 漢字 🙂 end"),
        (14, "a  b \n\n c <|endoftext|> d "),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with extra columns whose names operators use inside."""
    rows = [(i, t, "en", "s", 1, 2, 3, "k") for i, t in edge_rows()]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
        "node long, label int, _t string")


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
