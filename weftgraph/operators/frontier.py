"""Vertex sets and traversals. A frontier is a frame with one distinct column ``id``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.lookup import id_frame
from weftgraph.session import measured


class Frontier:
    """A set of vertices with set algebra and steps along out-edges; everything stays lazy.

    Whether a step broadcasts the set or shuffles it is decided at run time from
    its size.
    """

    def __init__(self, ids: DataFrame, edges: DataFrame):
        self.ids, self.edges = ids, edges

    @classmethod
    def of(cls, edges: DataFrame, *vertices: int) -> Frontier:
        return cls(id_frame(edges.sparkSession, vertices), edges)

    def _with(self, ids: DataFrame) -> Frontier:
        return Frontier(ids, self.edges)

    def pipe(self, *steps: Callable[[Frontier], object]):
        """Apply steps in order."""
        state: object = self
        for step in steps:
            state = step(state)
        return state

    # set algebra

    def union(self, other: Frontier) -> Frontier:
        return self._with(self.ids.union(other.ids).distinct())

    def remove(self, other: Frontier) -> Frontier:
        return self._with(self.ids.join(other.ids, "id", "left_anti"))

    def intersect(self, other: Frontier) -> Frontier:
        return self._with(self.ids.join(other.ids, "id", "left_semi"))

    def insert(self, *vertices: int) -> Frontier:
        return self.union(Frontier.of(self.edges, *vertices))

    def has_vertex(self, vertex: int) -> bool:
        return not self.ids.filter(F.col("id") == vertex).isEmpty()

    def has_any_vertex(self, other: Frontier) -> bool:
        return not self.intersect(other).ids.isEmpty()

    def is_empty(self) -> bool:
        return self.ids.isEmpty()

    def size(self) -> int:
        return self.ids.count()

    def limit(self, n: int, seed: int | None = None) -> Frontier:
        """All if there are at most ``n``, else ``n`` of them: at random with a seed, else the least."""
        return self._with(self.ids.orderBy("id" if seed is None else F.rand(seed)).limit(n))

    # steps

    def out_edges(self, etype: int | None, condition: Column | None = None) -> DataFrame:
        """The edges that leave the set."""
        rows = self.edges if etype is None else self.edges.filter(F.col("etype") == etype)
        if condition is not None:
            rows = rows.filter(condition)
        return rows.join(self.ids.withColumnRenamed("id", "src"), "src", "left_semi")

    def traverse_out(self, etype: int | None, condition: Column | None = None, to: Column | None = None) -> Frontier:
        """Distinct out-neighbours; ``condition`` and ``to`` filter and map (src, dst), nulls are dropped."""
        target = F.col("dst") if to is None else to
        return self._with(self.out_edges(etype, condition).select(target.cast("bigint").alias("id")).filter("id is not null").distinct())

    def traverse_out_until(self, etype: int | None, stop: Column, condition: Column | None = None, to: Column | None = None) -> tuple[Frontier, bool]:
        """``traverse_out`` and whether an edge on the way met ``stop``; both come from one pass over the edges, whose step is stored."""
        target = F.col("dst") if to is None else to
        rows = self.out_edges(etype, condition).select(target.cast("bigint").alias("id"), stop.alias("_stop"))
        step, seen = measured(rows.groupBy("id").agg(F.max("_stop").alias("_stop")), "step", stopped=F.max("_stop"))
        return self._with(step.filter("id is not null").select("id")), bool(seen.get("stopped"))

    def select_out(self, etype: int | None, condition: Column | None = None) -> DataFrame:
        """(id): the dst of every edge that leaves the set, as a bag."""
        return self.out_edges(etype, condition).select(F.col("dst").alias("id"))


def group_by(bag: DataFrame, **aggs: Column) -> DataFrame:
    """Aggregates by emitted vertex."""
    return bag.groupBy("id").agg(*[a.alias(n) for n, a in aggs.items()])


def group_fold(bag: DataFrame, value: str, zero: int, step: Callable[[int, int], int], merge: Callable[[int, int], int]) -> DataFrame:
    """(id, value): any fold of the emitted values (BIGINT) by vertex.

    Each batch folds its own rows by vertex before the exchange, so a hot vertex sends
    one partial result a batch. The outcome is fixed if order and grouping do not matter.
    Rows with a null id or value are left out.
    """
    import pyarrow as pa

    def partial(batches):
        for batch in batches:
            state: dict[int, int] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                state[i] = step(state.get(i, zero), v)
            yield pa.RecordBatch.from_arrays([pa.array(state.keys(), pa.int64()), pa.array(state.values(), pa.int64())], names=["id", "value"])

    def whole(batches):
        state: dict[int, int] = {}
        last = None
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i != last and len(state) >= 50_000:  # rows are sorted, so what is held is complete
                    yield pa.RecordBatch.from_arrays([pa.array(state.keys(), pa.int64()), pa.array(state.values(), pa.int64())], names=["id", "value"])
                    state = {}
                state[i] = merge(state[i], v) if i in state else v
                last = i
        yield pa.RecordBatch.from_arrays([pa.array(state.keys(), pa.int64()), pa.array(state.values(), pa.int64())], names=["id", "value"])

    rows = bag.select(F.col("id").cast("bigint").alias("id"), F.col(value).cast("bigint").alias("value")).filter("id is not null and value is not null")
    parts = rows.mapInArrow(partial, "id bigint, value bigint").repartition("id").sortWithinPartitions("id")
    return parts.mapInArrow(whole, "id bigint, value bigint")


def group_by_count(bag: DataFrame) -> DataFrame:
    """(id, count)."""
    return group_by(bag, count=F.count(F.lit(1)))


def without(groups: DataFrame, frontier: Frontier) -> DataFrame:
    """Groups whose key is not in the set."""
    return groups.join(frontier.ids, "id", "left_anti")
