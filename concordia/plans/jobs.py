"""The stages of a run as a plain list of DataFrame steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

# Stages in order; none waits for a person.
STAGES = ("ingest", "extract", "index", "enrich_via_web", "detect_conflicts", "compose_workbook")


def run(steps: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Apply the given steps in stage order; each gets all tables so far and its result is added under the stage's name."""
    unknown = set(steps) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    out = dict(tables)
    for name in STAGES:
        if name in steps:
            out[name] = steps[name](out)
    return out
