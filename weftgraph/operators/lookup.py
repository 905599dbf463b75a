"""Scans, point lookups, neighbour queries and column joins: single plans over the two tables.

Every function is lazy. Filters on ``src``, ``dst``, ``etype`` and ``id`` reach the
scan; results keep only the columns they name. Null ends or types never match.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.skew import HotKeys, hot_keys, salted_lookup

#: Lists of ids up to this length become literals of the filter, longer ones a semi-join.
MOST_LITERALS = 1_000


def id_frame(spark, ids) -> DataFrame:
    """Distinct ids as a one-column frame."""
    return spark.createDataFrame([(int(i),) for i in sorted(set(ids))], "id bigint")


def among(df: DataFrame, column: str, ids) -> DataFrame:
    """Rows whose column is one of ``ids`` (a Python collection or a frame with ``id``)."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_semi")
    ids = sorted({int(i) for i in ids})
    if len(ids) <= MOST_LITERALS:
        return df.filter(F.col(column).isin(ids))
    return df.join(id_frame(df.sparkSession, ids).withColumnRenamed("id", column), column, "left_semi")


# scans


def sweep(edges: DataFrame) -> DataFrame:
    """All edges."""
    return edges.select("src", "dst", "etype")


def sweep_in(edges: DataFrame, first: int, last: int, most: int | None = None, with_pointer: bool = False) -> DataFrame:
    """Edges whose dst lies in an inclusive range, up to the id ``most``."""
    last = last if most is None else min(last, most)
    return edges.filter(F.col("dst").between(first, last)).select("src", "dst", "etype", *(["edge_id"] if with_pointer else []))


def sweep_out(edges: DataFrame, first: int, last: int, with_pointer: bool = True) -> DataFrame:
    """Edges whose src lies in an inclusive range."""
    return edges.filter(F.col("src").between(first, last)).select("src", "dst", "etype", *(["edge_id"] if with_pointer else []))


def edges_from(edges: DataFrame, first: int = 0, in_order: bool = False) -> DataFrame:
    """Edges from the first src on, if wanted in the order (src, dst)."""
    rows = edges.filter(F.col("src") >= first)
    return rows.orderBy("src", "dst") if in_order else rows


# points


def value_of(table: DataFrame, key: str, at: int, column: str, default=None) -> DataFrame:
    """One column at one key; ``default`` where it is null."""
    value = F.col(column) if default is None else F.coalesce(column, F.lit(default))
    return table.filter(F.col(key) == at).select(key, value.alias(column))


def values_of(table: DataFrame, key: str, at, column: str) -> DataFrame:
    """One column at many keys; a key that is not there has no row."""
    return among(table, key, at).select(key, column)


def select_where(vertices: DataFrame, column: str, condition: Column) -> DataFrame:
    """(id, value) of the vertices that meet a condition."""
    return vertices.filter(condition).select("id", column)


def update_all(vertices: DataFrame, column: str, value: Column) -> DataFrame:
    """The table with one column computed anew for all rows."""
    return vertices.withColumn(column, value)


def fold(vertices: DataFrame, **aggs: Column) -> DataFrame:
    """Aggregates over a whole column, in one row."""
    return vertices.agg(*[a.alias(n) for n, a in aggs.items()])


def fold_values(vertices: DataFrame, column: str, zero: Any, step: Callable[[Any, Any], Any], merge: Callable[[Any, Any], Any]) -> Any:
    """Any fold over the non-null values of a column.

    Tasks fold their rows with ``step`` from ``zero``; the driver folds one result
    a task with ``merge``, so the outcome is fixed if order and grouping do not matter.
    """
    import pickle

    import pyarrow as pa

    def run(batches):
        state = zero
        for batch in batches:
            state = reduce(step, batch.column(0).drop_null().to_pylist(), state)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    parts = vertices.select(column).mapInArrow(run, "state binary").collect()
    return reduce(merge, (pickle.loads(bytes(r["state"])) for r in parts), zero)


def find_edge(edges: DataFrame, src: int, dst: int, etype: int | None) -> DataFrame:
    """The newest edge between two vertices: that of the greatest ``edge_id``; no row if there is none."""
    rows = edges.filter((F.col("src") == src) & (F.col("dst") == dst))
    if etype is not None:
        rows = rows.filter(F.col("etype") == etype)
    return rows.orderBy(F.desc("edge_id")).limit(1)


def by_pointer(edges: DataFrame, pointers, *columns: str) -> DataFrame:
    """Columns of the edges with the given ``edge_id``s."""
    return among(edges, "edge_id", pointers).select("edge_id", *columns)


def set_by_pointer(edges: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The table with ``column`` set for the edges that ``values`` (edge_id, value) names; other pointers are ignored."""
    new = values.select("edge_id", F.col("value").cast(dict(edges.dtypes)[column]).alias("_new"), F.lit(True).alias("_hit"))
    joined = edges.join(new, "edge_id", "left")
    return joined.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(*edges.columns)


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, in_degree, out_degree, degree) of all types together, by one aggregation.

    An edge adds one out at its src and one in at its dst; both are counted
    map-side, so hub vertices make no hot task. With ``vertices`` those without
    edges have zeros.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    if vertices is not None:
        ends = ends.unionByName(vertices.select(F.struct(F.col("id"), F.lit(0).alias("i"), F.lit(0).alias("o")).alias("e")))
    out = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def random_vertex(edges: DataFrame, seed: int, n: int = 1) -> DataFrame:
    """Vertices with at least one edge, drawn uniformly."""
    return degrees(edges).select("id").orderBy(F.rand(seed)).limit(n)


# neighbours


def query_out(edges: DataFrame, ids, etype: int | None) -> DataFrame:
    """(query_id, neighbor_id, etype, edge_id): out-edges of one or many vertices; parallel edges are kept."""
    rows = among(edges, "src", [ids] if isinstance(ids, int) else ids)
    if etype is not None:
        rows = rows.filter(F.col("etype") == etype)
    return rows.select(F.col("src").alias("query_id"), F.col("dst").alias("neighbor_id"), "etype", "edge_id")


def query_in(edges: DataFrame, ids, etype: int | None) -> DataFrame:
    """(query_id, neighbor_id, etype, edge_id): in-edges of one or many vertices."""
    rows = among(edges, "dst", [ids] if isinstance(ids, int) else ids)
    if etype is not None:
        rows = rows.filter(F.col("etype") == etype)
    return rows.select(F.col("dst").alias("query_id"), F.col("src").alias("neighbor_id"), "etype", "edge_id")


def batches(result: DataFrame, most: int = 1_000, width: int = 1_024) -> DataFrame:
    """(query_id, block, part, neighbors): a neighbour query's answers in sorted arrays of at most ``most``.

    A block holds the neighbours of ``width`` consecutive ids, so the answers of a hot
    key are spread over tasks and no task gathers them; a block of more than ``most``
    answers comes in parts, in the order of neighbour and edge.
    """
    blocks = result.withColumn("block", F.floor(F.col("neighbor_id") / width))
    order = Window.partitionBy("query_id", "block").orderBy("neighbor_id", "edge_id")
    parts = blocks.withColumn("part", F.floor((F.row_number().over(order) - 1) / most))
    return parts.groupBy("query_id", "block", "part").agg(F.sort_array(F.collect_list("neighbor_id")).alias("neighbors"))


def first_n(result: DataFrame, n: int) -> DataFrame:
    """At most ``n`` answers of each query, the least neighbours first."""
    order = Window.partitionBy("query_id").orderBy("neighbor_id", "edge_id")
    return result.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def _known(df: DataFrame, column: str) -> Column:
    """A column's value; a NaN is no value and becomes null, so that equal rows are equal to every reader."""
    return (F.nanvl(column, F.lit(None)) if dict(df.dtypes)[column] in ("float", "double") else F.col(column)).alias(column)


def join_edge_columns(result: DataFrame, edges: DataFrame, *columns: str) -> DataFrame:
    """(neighbor_id, columns) of a neighbour query, as a set: equal rows come once; a NaN comes as null."""
    lacking = [c for c in columns if c not in edges.columns]
    if lacking:
        raise ValueError(f"not edge columns: {lacking}")
    if "edge_id" not in result.columns:
        raise ValueError("edge columns join results that are indexed by edge")
    return result.join(edges.select("edge_id", *[_known(edges, c) for c in columns]), "edge_id").select("neighbor_id", *columns).distinct()


def join_vertex_columns(result: DataFrame, vertices: DataFrame, *columns: str) -> DataFrame:
    """(id, columns) of the distinct vertices of a neighbour query."""
    lacking = [c for c in columns if c not in vertices.columns]
    if lacking:
        raise ValueError(f"not vertex columns: {lacking}")
    return result.select(F.col("neighbor_id").alias("id")).distinct().join(vertices.select("id", *columns), "id")


def sweep_in_join(
    edges: DataFrame, vertices: DataFrame, first: int, last: int, vertex_columns: list[str], edge_columns: list[str] = (), hot: HotKeys | None = None
) -> DataFrame:
    """In-edges of a range of dst, each with columns of its src vertex and of its own; a NaN comes as null.

    Edges whose src has no vertex are left out. Hot sources, counted first if they are not given, are spread over salts.
    """
    rows = edges.filter(F.col("dst").between(first, last)).select("src", "dst", "etype", *[_known(edges, c) for c in edge_columns])
    own = vertices.select(F.col("id").alias("src"), *[_known(vertices, c) for c in vertex_columns])
    hot = hot if hot is not None else hot_keys(rows.select("src"), "src")
    return salted_lookup(rows, own, "src", hot, ["dst"]).select("src", "dst", "etype", *vertex_columns, *edge_columns)


def map_out(edges: DataFrame, ids, etype: int | None, value: Column, name: str = "value") -> DataFrame:
    """(query_id, value): an expression over each out-edge of the given vertices."""
    rows = among(edges, "src", [ids] if isinstance(ids, int) else ids)
    if etype is not None:
        rows = rows.filter(F.col("etype") == etype)
    return rows.select(F.col("src").alias("query_id"), value.alias(name))


# dictionary


def ids_of(names: DataFrame, dictionary: DataFrame, name: str, strict: bool = False) -> DataFrame:
    """(name, id): dictionary lookup; a missing name has id -1, or raises if ``strict``."""
    found = names.join(dictionary.select(F.col(name), F.col("id").cast("bigint").alias("id")), name, "left")
    missing = F.raise_error(F.concat(F.lit("unknown name: "), F.coalesce(name, F.lit("null")))).cast("bigint") if strict else F.lit(-1).cast("bigint")
    return found.select(name, F.when(F.col("id").isNull(), missing).otherwise(F.col("id")).alias("id"))
