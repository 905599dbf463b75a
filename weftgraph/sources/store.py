"""A stored graph: append-only segments of edges and vertices, changes and compaction on Parquet.

``segments`` holds one folder per commit, with edges in ranges of dst, sorted by src
within files, so statistics prune both directions; how many files there are
follows from the data, and a dst with very many edges is cut by src. ``changes`` holds
tombstones and updates by ``edge_id``, ``vertex_changes`` updates by ``id``, with the number of
their commit. A folder counts once it is complete; compaction puts one segment in
place of all before it, which a marker file makes effective in one step. What it
replaced stays until the next compaction, so readers that started before it can finish.
Row counts and claimed numbers are empty files whose names say them.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.model import ColumnSpec, GraphSchema, PropertyGraph
from weftgraph.operators.lookup import find_edge

#: Columns of these kinds cannot be changed after they were added.
_FIXED = ("vector", "counters", "bytes")


class GraphStore:
    """A graph in a folder. Every write is one commit, with a number of its own."""

    def __init__(self, spark: SparkSession, path: str, schema: GraphSchema, rows_per_file: int = 5_000_000):
        self.spark, self.path, self.schema, self.rows_per_file = spark, path.rstrip("/"), schema, rows_per_file

    # files

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, part: str) -> list[str]:
        fs, path = self._fs()
        root = path(f"{self.path}/{part}")
        return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []

    def _mark(self, part: str, name: str) -> bool:
        """Make an empty file; False if it exists, whoever made it."""
        fs, path = self._fs()
        try:
            fs.create(path(f"{self.path}/{part}/{name}"), False).close()
        except Py4JJavaError:
            if name in self._names(part):
                return False
            raise
        return True

    def exists(self) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.path}/segments"))

    def create(self, mode: str = "error") -> GraphStore:
        """Make an empty store; ``error`` if it exists, ``ignore`` to keep it, ``overwrite`` to empty it."""
        fs, path = self._fs()
        if self.exists():
            if mode == "ignore":
                return self
            if mode != "overwrite":
                raise FileExistsError(self.path)
            fs.delete(path(self.path), True)
        for part in ("segments", "changes", "vertices", "vertex_changes", "bases", "counts", "claims", "batches"):
            fs.mkdirs(path(f"{self.path}/{part}"))
        return self

    def _commits(self, part: str) -> list[str]:
        fs, path = self._fs()
        done = [n for n in self._names(part) if n.startswith("c") and fs.exists(path(f"{self.path}/{part}/{n}/_SUCCESS"))]
        if part.startswith("vert"):
            return done
        base = self._base()
        # a compacted segment counts only once it is the base, and then stands for all commits before it
        return [n for n in done if n[:11] >= base[:11] and (n == base or not n.endswith("-base"))]

    def _base(self) -> str:
        """The newest compacted segment that took effect, "" if there is none."""
        return max(self._names("bases"), default="")

    def _next(self, tag: str = "") -> str:
        """A new commit's name; its number is claimed by an empty file, so that no two writers have the same."""
        number = max((int(n[1:11]) for n in self._names("claims")), default=0) + 1
        while not self._mark("claims", f"c{number:010d}"):
            number += 1
        return f"c{number:010d}-{tag or uuid.uuid4().hex[:8]}"

    def _read(self, part: str, ddl: str) -> DataFrame:
        names = self._commits(part)
        if not names:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*[f"{self.path}/{part}/{n}" for n in names])

    def _write(self, rows: DataFrame, part: str, name: str, counts: bool = True) -> int:
        """Write a commit and note its number of rows if that ``counts``; a commit without rows is taken back."""
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.option("maxRecordsPerFile", self.rows_per_file).parquet(f"{self.path}/{part}/{name}")
        try:
            n = seen.get.get("n") or 0
        except Py4JJavaError:  # the plan of an empty table has no place to observe
            n = 0
        if n:
            self._mark("counts", f"{name}={n if counts else 0}")
        else:
            fs, path = self._fs()
            fs.delete(path(f"{self.path}/{part}/{name}"), True)
        return n

    def _rows(self, part: str) -> int:
        """Rows of a part's commits, by their notes."""
        counts = dict(n.rsplit("=", 1) for n in self._names("counts"))
        return sum(int(counts.get(n, 0)) for n in self._commits(part))

    # writing

    def _arranged(self, rows: DataFrame) -> DataFrame:
        """By ranges of (dst, src), as many as the data needs; sorted by src within."""
        return rows.repartitionByRange("dst", "src").sortWithinPartitions("src", "dst")

    def add_edges(self, df: DataFrame, given: list[str] = (), batch: str | None = None) -> str:
        """Append edges; visible to reads that start after it. Gives the commit's name.

        A ``batch`` that was committed before, here or by a run that failed since, is not added again.
        """
        rows = self.schema.fill_edges(df, list(given))
        tag = "b" + re.sub(r"[^\w]", "_", batch) if batch else ""
        if tag:
            fs, path = self._fs()
            held = [n for n in self._names("segments") if n[12:] == tag]
            done = [n for n in held if fs.exists(path(f"{self.path}/segments/{n}/_SUCCESS"))]
            if done or tag in self._names("batches"):
                return done[0] if done else tag
        name = self._next(tag)
        self._write(self._arranged(rows), "segments", name)
        if tag:
            self._mark("batches", tag)
        return name

    def add_vertices(self, df: DataFrame) -> str:
        """Append vertices; one that is there already is replaced."""
        name = self._next()
        self._write(self.schema.fill_vertices(df).withColumn("commit", F.lit(int(name[1:11])).cast("bigint")), "vertices", name)
        return name

    _CHANGES = "edge_id bigint, deleted boolean, name string, value string, commit bigint"
    _VERTEX_CHANGES = "id bigint, name string, value string, commit bigint"

    def _change(self, rows: DataFrame, part: str = "changes", counts: bool = False) -> int:
        name = self._next()
        return self._write(rows.withColumn("commit", F.lit(int(name[1:11])).cast("bigint")), part, name, counts)

    def _delete(self, edges: DataFrame) -> bool:
        doomed = edges.select("edge_id", F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"))
        return self._change(doomed, counts=True) > 0

    def delete_edge(self, src: int, dst: int, etype: int | None) -> bool:
        """Delete the newest matching edge; whether there was one. Parallel edges stay."""
        return self._delete(find_edge(self.edges((dst, dst)), src, dst, etype))

    def update_edge(self, src: int, dst: int, etype: int | None, column: str, value) -> bool:
        """Set a column of the newest matching edge; whether there was one."""
        hit = find_edge(self.edges((dst, dst)), src, dst, etype).select("edge_id", F.lit(None if value is None else str(value)).cast("string").alias("value"))
        return self.set_by_pointer(hit, column) > 0

    def set_by_pointer(self, values: DataFrame, column: str) -> int:
        """Set a column of the edges that ``values`` (edge_id, value) names; how many rows it had."""
        if self.schema.column(column, "edge").kind in _FIXED:
            raise ValueError(f"{column} cannot be changed")
        return self._change(values.select("edge_id", F.lit(False).alias("deleted"), F.lit(column).alias("name"), F.col("value").cast("string").alias("value")))

    def set_vertex_values(self, values: DataFrame, column: str) -> int:
        """Set a column of the vertices that ``values`` (id, value) names; how many rows it had."""
        if self.schema.column(column, "vertex").kind in _FIXED:
            raise ValueError(f"{column} cannot be changed")
        return self._change(values.select("id", F.lit(column).alias("name"), F.col("value").cast("string").alias("value")), "vertex_changes")

    def delete_vertex(self, vertex: int) -> bool:
        """Delete all edges of a vertex in both directions and of all types; whether there were any."""
        return self._delete(self.edges().filter((F.col("src") == vertex) | (F.col("dst") == vertex)))

    # reading

    @staticmethod
    def _updated(rows: DataFrame, updates: DataFrame, key: str, columns: list[ColumnSpec], fixed: list[str], since: Column | None = None) -> DataFrame:
        """Rows with the newest update of each column, if it is newer than ``since``."""
        newest = Window.partitionBy(key, "name").orderBy(F.desc("commit"), F.desc("value"))
        last = updates.withColumn("_r", F.row_number().over(newest)).filter("_r = 1")
        last = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("value", F.col("commit").alias("at"))))).alias("_new"))
        joined = rows.join(last, key, "left")

        def value(c: ColumnSpec) -> Column:
            if c.kind in _FIXED:
                return F.col(c.name)
            new = F.col("_new")[c.name]
            changed = new.isNotNull() if since is None else new["at"] > since
            return F.when(F.coalesce(changed, F.lit(False)), new["value"].cast(c.spark_type)).otherwise(F.col(c.name))

        return joined.select(*fixed, *[value(c).alias(c.name) for c in columns])

    def edges(self, dst: tuple[int, int] | None = None) -> DataFrame:
        """The live edges with their present values; ``dst`` limits to a range, by which files are skipped."""
        rows = self._read("segments", self.schema.edge_ddl())
        if dst is not None:
            rows = rows.filter(F.col("dst").between(*dst))
        if not self._commits("changes"):
            return rows
        changes = self._read("changes", self._CHANGES)
        rows = rows.join(changes.filter("deleted").select("edge_id"), "edge_id", "left_anti")
        return self._updated(rows, changes.filter("not deleted"), "edge_id", list(self.schema.edge.values()), ["src", "dst", "etype", "edge_id"])

    def vertices(self) -> DataFrame:
        """The vertices, each as it was added last, with the updates made since."""
        rows = self._read("vertices", self.schema.vertex_ddl() + ", commit bigint")
        columns = list(self.schema.vertex.values())
        if len(self._commits("vertices")) > 1:
            held = F.max_by(F.struct("commit", *self.schema.vertex), "commit").alias("v")
            rows = rows.groupBy("id").agg(held).select("id", "v.*")
        if self._commits("vertex_changes"):
            changes = self._read("vertex_changes", self._VERTEX_CHANGES)
            return self._updated(rows, changes, "id", columns, ["id"], F.col("commit"))
        return rows.drop("commit")

    def graph(self) -> PropertyGraph:
        return PropertyGraph(self.vertices(), self.edges(), self.schema)

    # maintenance

    def deleted_share(self) -> float:
        """Tombstones per stored edge, by the notes of the commits, without reading them."""
        stored = self._rows("segments")
        return self._rows("changes") / stored if stored else 0.0

    def compact(self, least_share: float = 0.0) -> bool:
        """Rewrite the live edges as one segment without changes, if enough are deleted.

        What the compaction before it replaced is removed; what this one replaces stays for readers at work.
        """
        if least_share and self.deleted_share() < least_share:
            return False
        old = [(p, n) for p in ("segments", "changes") for n in self._commits(p)]
        if not old:
            return False
        before = self._base()
        name = f"{self._next()}-base"
        if not self._write(self._arranged(self.edges()), "segments", name):
            fs, path = self._fs()  # no edge is left: an empty base
            self.spark.createDataFrame([], self.schema.edge_ddl()).write.parquet(f"{self.path}/segments/{name}")
        self._mark("bases", name)
        self._vacuum(before)
        return True

    def _vacuum(self, base: str) -> None:
        """Remove what an older base replaced."""
        fs, path = self._fs()
        for part in ("segments", "changes"):
            for n in self._names(part):
                if base and n[:11] < base[:11]:
                    fs.delete(path(f"{self.path}/{part}/{n}"), True)
