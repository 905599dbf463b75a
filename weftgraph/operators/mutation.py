"""Edits of an edge table as plans: the table without or with changed rows.

Of several parallel edges the newest one, that of the greatest ``edge_id``, is hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.lookup import find_edge


def delete_edge(edges: DataFrame, src: int, dst: int, etype: int | None) -> DataFrame:
    """The table without the newest matching edge; unchanged if there is none."""
    hit = find_edge(edges, src, dst, etype).select("edge_id")
    return edges.join(F.broadcast(hit), "edge_id", "left_anti")


def delete_vertex(edges: DataFrame, vertex: int) -> DataFrame:
    """The table without all edges of a vertex."""
    return edges.filter((F.col("src") != vertex) & (F.col("dst") != vertex))


def update_edge(edges: DataFrame, src: int, dst: int, etype: int | None, column: str, value) -> DataFrame:
    """The table with a column of the newest matching edge set."""
    hit = find_edge(edges, src, dst, etype).select("edge_id", F.lit(True).alias("_hit"))
    joined = edges.join(F.broadcast(hit), "edge_id", "left")
    kind = dict(edges.dtypes)[column]
    return joined.withColumn(column, F.when(F.col("_hit"), F.lit(value).cast(kind)).otherwise(F.col(column))).select(*edges.columns)


def drop_tombstones(edges: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Edges that no tombstone names."""
    return edges.join(tombstones.select("edge_id").distinct(), "edge_id", "left_anti")


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """The table with further edges of the same columns."""
    return edges.unionByName(more.select(*edges.columns))
