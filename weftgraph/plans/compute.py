"""Vertex programs as synchronous supersteps over DataFrames."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.lookup import id_frame
from weftgraph.operators.skew import HotKeys, hot_keys, salted_lookup
from weftgraph.plans.traversal import symmetric
from weftgraph.session import materialize, measured


class Scheduler:
    """Which vertices take part in the next round, beside those a program's ``changed`` names."""

    def __init__(self) -> None:
        self._ids: list = []
        self._all = False

    def add_task(self, vertex: int) -> None:
        self._ids.append([vertex])

    def add_tasks(self, ids) -> None:
        """Many vertices: a collection of ids or a frame with ``id``."""
        self._ids.append(ids)

    def add_task_to_all(self) -> None:
        self._all = True

    def has_new_tasks(self) -> bool:
        return self._all or bool(self._ids)

    def take(self, state: DataFrame) -> DataFrame:
        """The state with the scheduled vertices active; the schedule is empty then."""
        if self._all:
            state = state.withColumn("_active", F.lit(True))
        for ids in self._ids if not self._all else []:
            frame = ids.select("id").distinct() if isinstance(ids, DataFrame) else id_frame(state.sparkSession, ids)
            marked = state.join(frame.withColumn("_more", F.lit(True)), "id", "left")
            state = marked.withColumn("_active", F.col("_active") | F.coalesce("_more", F.lit(False))).drop("_more")
        self._ids, self._all = [], False
        return state


class VertexProgram(ABC):
    """What a vertex program says: its start state, its messages, how they combine, and the new state.

    State columns are those of ``init``. Messages go along edges from src to dst;
    expressions may use the columns of the src vertex and of the edge. ``changed``
    names the vertices that send in the next round (selective scheduling); the hooks may
    schedule more. ``set_out_edges`` and ``set_in_edges`` give new values of edge columns, over the
    edge and the new state of its src or dst; active vertices alone write, and the next round's
    messages read what they wrote.
    """

    both_ways = False

    @abstractmethod
    def init(self) -> dict[str, Column]: ...

    @abstractmethod
    def message(self) -> dict[str, Column]: ...

    @abstractmethod
    def combine(self) -> dict[str, Column]: ...

    @abstractmethod
    def apply(self) -> dict[str, Column]: ...

    def changed(self) -> Column | None:
        """Over the old state (``old_`` names) and the new one; None: all vertices stay active."""
        return None

    def set_out_edges(self) -> dict[str, Column]:
        return {}

    def set_in_edges(self) -> dict[str, Column]:
        return {}

    def before_iteration(self, i: int, scheduler: Scheduler) -> None: ...

    def after_iteration(self, i: int, scheduler: Scheduler) -> None: ...


def _write_edges(program: VertexProgram, edges: DataFrame, state: DataFrame, hot: dict[str, HotKeys]) -> DataFrame:
    """The edges with the values that the active vertices gave them: as their src first, then as their dst."""
    for end, values in (("src", program.set_out_edges()), ("dst", program.set_in_edges())):
        if values:
            own = state.filter("_active").drop("_active").withColumnRenamed("id", end).withColumn("_writes", F.lit(True))
            held = salted_lookup(edges, own, end, hot[end], ["dst" if end == "src" else "src"], "left")
            edges = held.withColumns({c: F.when(F.col("_writes"), v).otherwise(F.col(c)) for c, v in values.items()}).select(*edges.columns)
    return edges


def run_with_edges(program: VertexProgram, vertices: DataFrame, edges: DataFrame, iterations: int, least: int = 50_000, scheduler: Scheduler | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, state), edges): state and edge values after ``iterations`` rounds, or once no vertex is active.

    A round is one join of the active vertices with their edges, one map-side
    combined aggregation by dst and one join back. Hub vertices are spread over
    salts. Each round's state, and the edges if the program writes any, are written to the shared scratch folder.
    """
    scheduler = scheduler or Scheduler()
    columns = program.init()
    state = vertices.select("id", *[c.alias(n) for n, c in columns.items()], F.lit(True).alias("_active"))
    state = materialize(state, "state")
    edges = materialize(edges, "edges")
    writes = bool(program.set_out_edges() or program.set_in_edges())

    def both(rows: DataFrame) -> DataFrame:
        if not program.both_ways:
            return rows
        back = rows.withColumn("_s", F.col("dst")).withColumn("dst", F.col("src")).withColumn("src", F.col("_s")).drop("_s")
        return rows.unionByName(back)

    links = both(edges) if writes else materialize(both(edges), "links")
    hot = hot_keys(links.select("src"), "src", least=least)
    ends = {end: hot_keys(edges.select(end), end, least=least) for end in ("src", "dst")} if writes else {}
    if writes:
        edges = materialize(_write_edges(program, edges, state, ends), "edges")
        links = both(edges)
    for i in range(iterations):
        program.before_iteration(i, scheduler)
        state = scheduler.take(state)
        active = state.filter("_active").drop("_active").withColumnRenamed("id", "src")
        sent = salted_lookup(links, active, "src", hot, ["dst"]).select(F.col("dst").alias("id"), *[c.alias(n) for n, c in program.message().items()])
        inbox = sent.groupBy("id").agg(*[c.alias(n) for n, c in program.combine().items()])
        joined = state.drop("_active").join(inbox, "id", "left")
        new = joined.select("id", *[c.alias(n) for n, c in program.apply().items()], *[F.col(n).alias(f"old_{n}") for n in columns])
        rule = program.changed()
        active_now = F.lit(True) if rule is None else F.coalesce(rule, F.lit(False))
        state, seen = measured(new.select("id", *columns, active_now.alias("_active")), f"state{i}", active=F.max("_active"))
        if writes:
            edges = materialize(_write_edges(program, edges, state, ends), "edges")
            links = both(edges)
        program.after_iteration(i, scheduler)
        if rule is not None and not scheduler.has_new_tasks() and not seen.get("active"):
            break
    return state.drop("_active"), edges


def run_program(program: VertexProgram, vertices: DataFrame, edges: DataFrame, iterations: int, least: int = 50_000, scheduler: Scheduler | None = None) -> DataFrame:
    """(id, state): the state of ``run_with_edges``."""
    return run_with_edges(program, vertices, edges, iterations, least, scheduler)[0]


def pagerank(vertices: DataFrame, edges: DataFrame, iterations: int = 3, num_vertices: int | None = None, least: int = 50_000) -> DataFrame:
    """(id, rank) after synchronous rounds of 0.15/N + 0.85 * sum of max(0.15, rank) / outdegree, from rank 0.

    Parallel edges count; they are added up once, so a round joins one row per
    pair of vertices. All edge types take part; nothing is redistributed from
    vertices without out-edges. Ranks are doubles.
    """
    n = num_vertices or vertices.count()
    pairs = materialize(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "pairs")
    hot = hot_keys(pairs.select("src"), "src", least=least)
    out = pairs.groupBy("src").agg(F.sum("n").alias("out"))
    state = materialize(vertices.select("id").join(out.withColumnRenamed("src", "id"), "id", "left").withColumn("rank", F.lit(0.0)), "ranks")
    for i in range(iterations):
        share = state.filter("out > 0").select(F.col("id").alias("src"), (F.greatest(F.lit(0.15), F.col("rank")) / F.col("out")).alias("share"))
        got = salted_lookup(pairs, share, "src", hot, ["dst"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("n")).alias("got"))
        fresh = state.select("id", "out").join(got, "id", "left").select("id", "out", (F.lit(0.15 / n) + 0.85 * F.coalesce("got", F.lit(0.0))).alias("rank"))
        state = materialize(fresh, f"ranks{i}") if i + 1 < iterations else fresh
    return state.select("id", "rank")


def _hot(df: DataFrame, key: str, rows: int, least: int) -> HotKeys:
    """Hot keys of a stored table; a table of no more rows than the limit has none."""
    return hot_keys(df.select(key), key, least=least) if rows > least else HotKeys()


def connected_components(vertices: DataFrame, edges: DataFrame, least: int = 50_000) -> DataFrame:
    """(id, component): the least id of each weakly connected component; a vertex without edges keeps its own.

    Each vertex hooks to its least neighbour, and the hooks jump to their hook's
    hook a few times; then the edges connect hooks and not vertices, so the graph
    shrinks by a large factor a round. A null end makes no edge.
    """
    pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v and u is not null and v is not null")
    pairs, seen = measured(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs", n=F.count(F.lit(1)))
    maps: list[DataFrame] = []
    while n := seen.get("n", 0):
        both = symmetric(pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")))
        parent = materialize(both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("src"), F.min("dst")).alias("up")), "parent")
        for _ in range(3):
            high = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
            parent = materialize(salted_lookup(parent, high, "up", _hot(parent, "up", 2 * n, least), ["id"]).select("id", F.col("top").alias("up")), "parent")
        maps.append(parent)
        one = salted_lookup(pairs, parent.select(F.col("id").alias("u"), F.col("up").alias("a")), "u", _hot(pairs, "u", n, least), ["v"]).select("a", "v")
        two = salted_lookup(one, parent.select(F.col("id").alias("v"), F.col("up").alias("b")), "v", _hot(pairs, "v", n, least), ["a"]).filter("a <> b")
        pairs, seen = measured(two.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "pairs", n=F.count(F.lit(1)))
    label, seen = measured(vertices.select("id", F.col("id").alias("component")).distinct(), "labels", n=F.count(F.lit(1)))
    n = seen.get("n", 0)
    for parent in maps:
        up = parent.select(F.col("id").alias("component"), F.col("up").alias("_up"))
        label = salted_lookup(label, up, "component", _hot(label, "component", n, least), ["id"], "left").select("id", F.coalesce("_up", "component").alias("component"))
        label = materialize(label, "labels")
    # a label is the root of its tree, not always the least id of the component
    least_id = label.groupBy("component").agg(F.min("id").alias("_least"))
    return salted_lookup(label, least_id, "component", _hot(label, "component", n, least), ["id"]).select("id", F.col("_least").alias("component"))


def component_sizes(components: DataFrame, n: int = 20) -> DataFrame:
    """(component, size): the largest components of more than one vertex; ties go to the greater id."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return sizes.orderBy(F.desc("size"), F.desc("component")).limit(n)


class ReachableMin(VertexProgram):
    """Label propagation as a vertex program: the least label seen, over edges in both directions."""

    both_ways = True

    def init(self) -> dict[str, Column]:
        return {"label": F.col("id")}

    def message(self) -> dict[str, Column]:
        return {"got": F.col("label")}

    def combine(self) -> dict[str, Column]:
        return {"got": F.min("got")}

    def apply(self) -> dict[str, Column]:
        return {"label": F.least("label", F.coalesce("got", "label"))}

    def changed(self) -> Column:
        return F.col("label") < F.col("old_label")


class LabelsOnEdges(ReachableMin):
    """The same labels, sent over the edges: each vertex writes its label on its edges and reads the least one on them.

    The label that is left on an edge is the component of both its ends.
    """

    def message(self) -> dict[str, Column]:
        return {"got": F.col("edge_label")}

    def set_out_edges(self) -> dict[str, Column]:
        return {"edge_label": F.least("edge_label", "label")}

    def set_in_edges(self) -> dict[str, Column]:
        return {"edge_label": F.least("edge_label", "label")}


def label_edges(vertices: DataFrame, edges: DataFrame, iterations: int = 100) -> tuple[DataFrame, DataFrame]:
    """((id, label), edges with ``edge_label``) of the weakly connected components by their least id."""
    fresh = edges.withColumn("edge_label", F.lit(None).cast("bigint"))
    return run_with_edges(LabelsOnEdges(), vertices, fresh, iterations)
