"""Executors import the package from a shipped archive, as on a cluster."""

from __future__ import annotations

import pytest
from odd_rows import EXTRA, ODD


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from areastats.llm._spark import ship

    ship(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names the operators use themselves."""
    rows = [(*r, *[f"{c}{i}" for c in EXTRA]) for i, r in enumerate(ODD)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
