"""Writers of result tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_triple_frequencies(frequencies: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Columns edges0 to edges3, one row per graph."""
    write_csv(frequencies.select(*[f"edges{k}" for k in range(4)]), path, mode)


def write_level_histogram(histogram: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Columns vertex, level1, level2, ..., one row per seed."""
    write_csv(histogram, path, mode)
