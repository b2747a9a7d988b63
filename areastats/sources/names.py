"""Column-name normalisation (snake case), a metadata-only step (``toDF``).

The reference calls it and throws the result away (T1), so the engine leaves it off by
default; it is offered for readers that want snake-case names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def snake_case(name: str) -> str:
    """``BestEstimateCurrentGVA`` -> ``best_estimate_current_gva``; ``LAD23CD`` -> ``lad23cd``;
    ``TotalInnovateUKFunding`` -> ``total_innovate_uk_funding``."""
    s = re.sub(r"[^0-9A-Za-z]+", "_", name)
    s = re.sub(r"([a-z])([A-Z])", r"\1_\2", s)          # lower -> Upper
    s = re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", s)     # UPPER -> Upperlower
    s = re.sub(r"_+", "_", s).strip("_").lower()        # digits stay attached
    return s or "x"


def unique_names(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0) + 1
        seen[n] = k
        out.append(n if k == 1 else f"{n}_{k}")
    return out


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([snake_case(c) for c in df.columns]))
