"""The most frequent values of a column by a three-phase threshold top-k.

Nodes are hash partitions of the records. Phase one: each node reports its k
leading values; the k-th largest partial sum is a lower bound of the k-th largest
count. Phase two: each node reports every value that holds at least the bound's
even share there; what no node reports cannot reach the bound. Phase three: the
counts of the remaining candidates are fetched from all nodes, which is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import materialize, tasks


def local_counts(df: DataFrame, value: str, record: str, nodes: int) -> DataFrame:
    """(node, v, n): each node's count of each value, repeated records once.

    One exchange on the node; a record's copies meet on one node, so removing
    them and counting need no further exchange. Both are spillable hash
    aggregates over keys that are spread evenly, however skewed the values.
    """
    rows = df.select(F.col(value).alias("v"), F.col(record).alias("r")).filter("v is not null and r is not null")
    placed = rows.withColumn("node", F.pmod(F.xxhash64("r"), F.lit(nodes)).cast("int")).repartition(nodes, "node")
    return placed.dropDuplicates(["node", "r"]).groupBy("node", "v").agg(F.count(F.lit(1)).alias("n"))


def _kth(sums: DataFrame, k: int) -> int:
    """The k-th largest partial sum, 0 if there are fewer values."""
    top = sums.orderBy(F.desc("s")).limit(k).agg(F.min("s"), F.count(F.lit(1))).first()
    return top[0] if top[1] == k else 0


def top_k_frequent(df: DataFrame, value: str, record: str, k: int, nodes: int | None = None) -> tuple[DataFrame, int]:
    """((value, n) of the k most frequent values, number of records).

    ``record`` names a record; its repeated deliveries count once. Null values and
    null records are left out. Ties at the k-th place go to the smaller value;
    with fewer than k values all come out; an empty table gives no rows. Counts
    are exact. Other columns of ``df`` are ignored.
    """
    spark = df.sparkSession
    nodes = nodes or tasks(spark)
    local = materialize(local_counts(df, value, record, nodes), "local_counts")
    total = local.agg(F.sum("n")).first()[0] or 0
    # phase 1: the local leaders; the k rows a node reports are cut before the exchange
    order = Window.partitionBy("node").orderBy(F.desc("n"), "v")
    leaders = local.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    bound = _kth(leaders.groupBy("v").agg(F.sum("n").alias("s")), k)
    # phase 2: everything at or above the bound's share; a value missing on a node has less than the share there
    share = max(1, -(-bound // nodes))
    reported = materialize(
        local.filter(F.col("n") >= share).groupBy("v").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("seen")), "reported"
    )
    bound = max(bound, _kth(reported, k))
    candidates = reported.filter(F.col("s") + (F.lit(nodes) - F.col("seen")) * (share - 1) >= bound).select("v")
    # phase 3: exact counts of the candidates
    exact = local.join(candidates, "v", "left_semi").groupBy("v").agg(F.sum("n").alias("n"))
    return exact.orderBy(F.desc("n"), "v").limit(k).withColumnRenamed("v", value), total


def frequent_above(df: DataFrame, value: str, record: str, share: float) -> DataFrame:
    """(value, n): the values that hold at least ``share`` of all records.

    At most ``1 / share`` values can, so they are among the top that many.
    Nulls, ties and empty tables as in ``top_k_frequent``.
    """
    top, total = top_k_frequent(df, value, record, int(1 / share + 1e-9))
    return top.filter(F.col("n") >= share * total)
