"""Graphs made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.edges import usable_edges


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def edge_table(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, etype, edge_id, weight, ts): the usable edges of the sweeps, each once.

    Deliveries of an edge differ in ``ingested_at`` only, so equal rows are one edge; as
    all columns are grouping keys, filters on them reach the scan.
    """
    rows = usable_edges(table(spark, path, "result_edge"))
    return rows.select("src", "dst", "etype", F.col("data_ptr").alias("edge_id"), "weight", "ts").distinct()


def vertex_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, vtype, title, release_year): later vertices, each once, and the pages known from the start."""
    kind = F.lower(F.trim("vertextype"))
    late = table(spark, path, "vertices").dropDuplicates(["id"])
    late = late.select("id", F.when(kind.isin("user", "movie"), kind).alias("vtype"), "title", F.col("release_year").cast("int").alias("release_year"))
    pages = table(spark, path, "page_title").select("id", F.lit("page").alias("vtype"), "title", F.lit(None).cast("int").alias("release_year"))
    return late.unionByName(pages)


def part_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, etype, weight): parts on consecutive lines of an order; a multigraph."""
    line = table(spark, path, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("src"), kind.alias("etype"), F.col("l_quantity").alias("weight"))
    b = line.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "n"]).select("src", "dst", "etype", "weight")


def part_vertices(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, rating): customers, offset as users, and the parts they ordered."""
    orders = table(spark, path, "orders").select("o_orderkey", (F.col("o_custkey") + 200_000).alias("src"))
    line = table(spark, path, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("rating"))
    return orders.join(line, "o_orderkey").select("src", "dst", "rating")
