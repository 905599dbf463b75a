"""Cleaning rules shared by everything that reads edge sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The edge type that marks a deleted edge (fixed value of the data model).
DELETED = 15


def is_usable(src: str = "src", dst: str = "dst", etype: str = "etype") -> Column:
    """Both ends resolved (not null, at least 1), a known type, not deleted."""
    return (F.col(src) >= 1) & (F.col(dst) >= 1) & F.col(etype).isNotNull() & (F.col(etype) != DELETED)


def usable_edges(df: DataFrame) -> DataFrame:
    """Rows of usable edges; repeated deliveries are still in it."""
    return df.filter(is_usable())
