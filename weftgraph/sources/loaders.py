"""Readers of edge lists, ratings, titles and page dumps. All are lazy and read files in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Users of a ratings file get ids beyond those of the items (fixed value of the data model).
USER_OFFSET = 200_000


def edge_id() -> Column:
    """Ids of the rows of a scan: unique, and rising in the order of a file's lines, so that parallel edges are told apart and a later line is the newer edge.

    The numbers follow the splits of the files; store the table to keep them.
    """
    return F.monotonically_increasing_id()


def _checked(rows: DataFrame, valid: Column, line: str, bad: str) -> DataFrame:
    """Rows that are valid; a bad line raises, or is left out with ``bad="skip"``."""
    if bad not in ("raise", "skip"):
        raise ValueError("bad lines either raise or are skipped")
    valid = F.coalesce(valid, F.lit(False))
    if bad == "raise":
        valid = F.when(valid, True).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col(line))).cast("boolean"))
    return rows.filter(valid)


def _fields(spark: SparkSession, path: str) -> tuple[DataFrame, Column]:
    """(line, edge_id, t): tab-separated fields of the lines without comments and blank ones, with their rule of validity."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), edge_id().alias("edge_id"))
    rows = lines.filter(~F.col("line").startswith("#") & (F.trim("line") != "")).withColumn("t", F.split("line", "\t"))
    return rows, F.expr("try_cast(get(t, 0) as bigint) is not null and try_cast(get(t, 1) as bigint) is not null")


def read_edge_list(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    """(src, dst, etype, edge_id, ts, weight) of tab-separated lines with ``#`` comments, as edges of type 0.

    A third field is the time in seconds since 1970, a fourth the weight; both are null where
    they lack. A line without two ids of 64 bits raises; with ``bad="skip"`` it is left
    out, and ``rejected_edges`` gives it.
    """
    rows, valid = _fields(spark, path)
    return _checked(rows, valid, "line", bad).select(
        F.expr("try_cast(get(t, 0) as bigint)").alias("src"), F.expr("try_cast(get(t, 1) as bigint)").alias("dst"), F.lit(0).cast("tinyint").alias("etype"), "edge_id",
        F.expr("timestamp_seconds(try_cast(get(t, 2) as double))").alias("ts"), F.expr("try_cast(get(t, 3) as float)").alias("weight"),
    )


def rejected_edges(spark: SparkSession, path: str) -> DataFrame:
    """(line): the lines of an edge list that hold no two ids."""
    rows, valid = _fields(spark, path)
    return rows.filter(~F.coalesce(valid, F.lit(False))).select("line")


def read_matrix_market(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    """Ratings of a coordinate file: user, item, ..., rating last; users are offset.

    Comment lines start with ``%``; the line of sizes is the first one without
    ``%`` of a file, found by its place within the file. A line without ids and a rating raises or is skipped.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("f"), edge_id().alias("edge_id"))
    lines = lines.filter(~F.col("line").startswith("%") & (F.trim("line") != ""))
    sizes = lines.groupBy("f").agg(F.min("edge_id").alias("edge_id"))
    body = lines.join(F.broadcast(sizes), ["f", "edge_id"], "left_anti").withColumn("t", F.split(F.trim("line"), r"\s+"))
    valid = F.expr("size(t) >= 3 and try_cast(get(t, 0) as bigint) is not null and try_cast(get(t, 1) as bigint) is not null and try_cast(element_at(t, -1) as double) is not null")
    return _checked(body, valid, "line", bad).select(
        (F.expr("try_cast(get(t, 0) as bigint)") + USER_OFFSET).alias("src"), F.expr("try_cast(get(t, 1) as bigint)").alias("dst"),
        F.lit(0).cast("tinyint").alias("etype"), F.expr("try_cast(element_at(t, -1) as double)").cast("tinyint").alias("rating"), "edge_id",
    )


def read_titles(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    """(id, year, title) of ``id,year,title`` lines in ISO-8859-1; a year of NULL is 0; titles keep their commas.

    A line without an id, a year and a title raises or is skipped.
    """
    lines = spark.read.schema("value string").csv(path, encoding="ISO-8859-1", sep="\x01", quote="", escape="")
    rows = lines.filter("value is not null").withColumn("t", F.split("value", ",", 3))
    year = F.when(F.get("t", F.lit(1)) == "NULL", 0).otherwise(F.expr("try_cast(get(t, 1) as smallint)"))
    valid = (F.size("t") == 3) & F.expr("try_cast(get(t, 0) as bigint)").isNotNull() & year.isNotNull()
    return _checked(rows, valid, "value", bad).select(F.expr("try_cast(get(t, 0) as bigint)").alias("id"), year.cast("smallint").alias("year"), F.get("t", F.lit(2)).alias("title"))


# a quoted string of a dump: any characters but quote and backslash, or escaped ones
_TUPLE = r"\((\d+),(-?\d+),'((?:[^'\\]|\\.)*)'"


def _tuples(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path).filter(F.col("value").startswith("INSERT INTO"))
    found = lines.select(F.explode(F.regexp_extract_all("value", F.lit(_TUPLE), F.lit(0))).alias("x"))
    title = F.regexp_replace(F.regexp_extract("x", _TUPLE, 3), r"\\(.)", "$1")
    return found.select(F.regexp_extract("x", _TUPLE, 1).cast("bigint").alias("id"), F.regexp_extract("x", _TUPLE, 2).cast("int").alias("ns"), title.alias("title"))


def read_page_dump(spark: SparkSession, path: str) -> DataFrame:
    """(id, ns, title) of the tuples of a page table dump; escaped quotes are unescaped."""
    return _tuples(spark, path)


def read_link_dump(spark: SparkSession, path: str) -> DataFrame:
    """(src, ns, title, edge_id) of the tuples of a link table dump."""
    return _tuples(spark, path).withColumnRenamed("id", "src").withColumn("edge_id", edge_id())


def pages_of(dump: DataFrame) -> DataFrame:
    """(id, title) of the pages in namespace 0."""
    return dump.filter("ns = 0").select("id", "title")


def resolve_links(links: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved links): titles become ids; links to missing pages and to the page itself are no edges.

    Edges keep the ``edge_id`` of their link; where links have none, equal ones are
    numbered, and their ends and that number are hashed. A null title is unresolved.
    """
    first = pages.groupBy("title").agg(F.min("id").alias("dst"))
    named = ["edge_id"] if "edge_id" in links.columns else []
    own = links.filter("ns = 0").select("src", "title", *named)
    edges = own.join(first, "title").filter("src <> dst")
    if not named:
        order = Window.partitionBy("src", "dst").orderBy("title")
        edges = edges.withColumn("edge_id", F.xxhash64("src", "dst", F.row_number().over(order)))
    return edges.select("src", "dst", F.lit(0).cast("tinyint").alias("etype"), "edge_id"), own.join(first, "title", "left_anti").drop("edge_id")
