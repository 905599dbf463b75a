"""Sorts, merges, order statistics and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.hotkeys import select_ranks
from weftgraph.session import materialize


def sort_with_values(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in the order of the keys, payload columns with them."""
    return df.orderBy(*keys)


def argsort(values: Column) -> Column:
    """Positions, from 0, of an array's entries in ascending order; equal entries keep their order."""
    pairs = F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def rank_rows(df: DataFrame, value: str, tie: str, name: str = "rank") -> DataFrame:
    """Rows with their position, from 0, in a global order.

    The rows are range-partitioned and numbered within their partition; the
    offsets are one count per partition. No task sees more than its range.
    """
    ranged = df.repartitionByRange(value, tie).sortWithinPartitions(value, tie)
    marked = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    marked = materialize(marked, "ranked")
    firsts = marked.groupBy("_p").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    done, offsets = 0, []
    for r in firsts.orderBy("_p").collect():  # one row per partition
        offsets.append((r["_p"], r["_first"], done))
        done += r["_n"]
    table = df.sparkSession.createDataFrame(offsets, "_p int, _first bigint, _off bigint")
    return marked.join(F.broadcast(table), "_p").withColumn(name, F.col("_m") - F.col("_first") + F.col("_off")).drop("_p", "_m", "_first", "_off")


def merge_sorted(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """Two runs as one, in order; rows of ``first`` come before equal ones of ``second``."""
    both = first.withColumn("_run", F.lit(0)).unionByName(second.withColumn("_run", F.lit(1)))
    return both.orderBy(*keys, "_run").drop("_run")


def quick_select(df: DataFrame, value: str, n: int) -> int | None:
    """The n-th least value, from 0, by refining histograms; None if there are not so many."""
    rows = df.select(F.lit(0).alias("_k"), F.col(value).cast("bigint").alias("_v")).filter("_v is not null")
    low, high, count = rows.agg(F.min("_v"), F.max("_v"), F.count("_v")).first()
    if n < 0 or n >= count:
        return None
    return select_ranks(rows, ["_k"], "_v", {(0,): (low, high)}, {(0,): [n]})[0].value


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of an order, each task keeping ``n``."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement."""
    return df.orderBy(F.rand(seed)).limit(n)
