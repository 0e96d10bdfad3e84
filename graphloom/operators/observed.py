"""Counts that are taken inside the job that makes the rows, so that a report costs no job of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..shared import cut


def counted_cut(rows: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The rows, kept and without lineage, and what was counted on the way: `n`, the number of rows, or the aggregates given.

    The numbers are those of the tasks whose rows were kept; a stage that runs again does not count twice.
    """
    seen = Observation()
    kept = cut(rows.observe(seen, *[c.alias(name) for name, c in (counts or {"n": F.count(F.lit(1))}).items()]))
    return kept, {name: value or 0 for name, value in seen.get.items()}
