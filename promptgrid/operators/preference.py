"""Preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that change sides together.
SIDES = ("response", "response_score", "response_assessment", "model_id")


def swap_by_score(df: DataFrame) -> DataFrame:
    """Chosen and rejected change places where the rejected score is strictly higher; ties and nulls stay."""
    there = [s for s in SIDES if f"chosen_{s}" in df.columns]
    swap = F.coalesce(F.col("rejected_response_score") > F.col("chosen_response_score"), F.lit(False))
    moved = {f"{a}_{s}": F.when(swap, F.col(f"{b}_{s}")).otherwise(F.col(f"{a}_{s}")) for s in there for a, b in (("chosen", "rejected"), ("rejected", "chosen"))}
    return df.withColumns(moved)
