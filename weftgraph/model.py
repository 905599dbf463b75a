"""The property graph: two DataFrames and a schema that says how to read and fill them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column types of the data model and what they are in Spark.
TYPES = {
    "int": "int", "short": "smallint", "float": "float", "long": "bigint", "byte": "tinyint",
    "categorical": "string", "string": "string", "bytes": "binary", "vector": "array<double>", "counters": "array<tinyint>",
}
#: Edge types run from 0 to this; the next value marks deleted edges and is refused.
LAST_TYPE = 14


@dataclass(frozen=True)
class ColumnSpec:
    """A declared column: its type, the values a categorical one may have, and what fills it if it is not given."""

    name: str
    kind: str
    domain: tuple[str, ...] = ()
    default: Callable[..., Column] | None = None
    temporary: bool = False

    @property
    def spark_type(self) -> str:
        return TYPES[self.kind]


@dataclass
class GraphSchema:
    """Declared vertex and edge columns; columns are known by name, in the order of declaration."""

    vertex: dict[str, ColumnSpec] = field(default_factory=dict)
    edge: dict[str, ColumnSpec] = field(default_factory=dict)

    def add(self, indexing: str, name: str, kind: str, domain: tuple[str, ...] = (), default: Callable[..., Column] | None = None, temporary: bool = False) -> GraphSchema:
        """Declare a column of the ``vertex`` or ``edge`` table."""
        table = self._table(indexing)
        if kind not in TYPES:
            raise ValueError(f"unknown column type {kind}")
        if name in table:
            raise ValueError(f"column {name} is declared already")
        if kind == "categorical" and not 0 < len(domain) <= 256:
            raise ValueError("a categorical column has 1 to 256 values")
        table[name] = ColumnSpec(name, kind, tuple(domain), default, temporary)
        return self

    def column(self, name: str, indexing: str) -> ColumnSpec:
        """The declared column; a name or index space that does not exist is an error."""
        return self._table(indexing)[name]

    def _table(self, indexing: str) -> dict[str, ColumnSpec]:
        if indexing not in ("vertex", "edge"):
            raise ValueError("columns are indexed by vertex or by edge")
        return self.vertex if indexing == "vertex" else self.edge

    def vertex_ddl(self) -> str:
        return ", ".join(["id bigint", *(f"`{c.name}` {c.spark_type}" for c in self.vertex.values())])

    def edge_ddl(self) -> str:
        return ", ".join(["src bigint, dst bigint, etype tinyint, edge_id bigint", *(f"`{c.name}` {c.spark_type}" for c in self.edge.values())])

    def fill_edges(self, df: DataFrame, given: list[str]) -> DataFrame:
        """Edges with all declared columns: ``given`` as they are, the others by their defaults.

        A declared column without default that is not given is an error, as is an
        edge type outside the domain or a null end or type (raised when the rows
        are read). No row is dropped.
        """
        missing = [c for c in self.edge.values() if c.name not in given]
        lacking = [c.name for c in missing if c.default is None]
        unknown = [c for c in given if c not in self.edge]
        if lacking or unknown:
            raise ValueError(f"edge values must be those declared; missing {lacking}, unknown {unknown}")
        valid = F.col("etype").between(0, LAST_TYPE) & F.col("src").isNotNull() & F.col("dst").isNotNull()
        checked = F.when(F.coalesce(valid, F.lit(False)), F.col("etype").cast("tinyint")).otherwise(
            F.raise_error(F.lit(f"an edge needs two ends and a type from 0 to {LAST_TYPE}")).cast("tinyint")
        )
        cols = [F.col(c.name).cast(c.spark_type).alias(c.name) if c.name in given else c.default("src", "dst", "etype").cast(c.spark_type).alias(c.name) for c in self.edge.values()]
        return df.select("src", "dst", checked.alias("etype"), "edge_id", *cols)

    def fill_vertices(self, df: DataFrame) -> DataFrame:
        """Vertices with all declared columns; missing ones take their default or null."""
        have = set(df.columns)
        cols = []
        for c in self.vertex.values():
            value = F.col(c.name) if c.name in have else c.default("id") if c.default else F.lit(None)
            cols.append(value.cast(c.spark_type).alias(c.name))
        return df.select(F.col("id").cast("bigint").alias("id"), *cols)


@dataclass
class PropertyGraph:
    """A directed multigraph: ``vertices(id, ...)`` and ``edges(src, dst, etype, edge_id, ...)``.

    Parallel edges and self-loops are kept. Operators take and give DataFrames;
    this class only holds the two tables together.
    """

    vertices: DataFrame
    edges: DataFrame
    schema: GraphSchema | None = None

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def of_type(self, etype: int | None) -> DataFrame:
        """Edges of one type; None for all types."""
        return self.edges if etype is None else self.edges.filter(F.col("etype") == etype)

    def num_edges(self) -> int:
        return self.edges.count()

    def num_vertices(self) -> int:
        return self.vertices.count()
