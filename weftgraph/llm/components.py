"""Groups of linked records by low-diameter decomposition.

Every vertex draws an exponentially distributed head start. Clusters grow from
all vertices at once, one hop a round; a vertex joins the cluster that reaches it
first by start time plus hops. Clusters contract to super-vertices, the edges
between clusters form a smaller graph, and the same is done to it until no edge
is left. The assignments of all levels are then composed.

Growth stops after a fixed number of rounds. That is exact: a vertex only joins a
cluster within its component, so contraction neither joins nor splits components;
a stopped cluster merely leaves more for the next level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.skew import HotKeys, hot_keys, hot_limit, salted_lookup
from weftgraph.session import materialize

#: Rate of the exponential head starts: an edge is cut with a probability of about this.
BETA = 0.1
#: Hops a cluster may grow on one level.
ROUNDS = 4


def _head_start(vertex: str, level: int, beta: float):
    """A vertex's draw from Exp(beta), the same in every attempt of a task."""
    unit = (F.pmod(F.xxhash64(F.col(vertex), F.lit(level)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    return -F.log(unit) / F.lit(beta)


def decompose(edges: DataFrame, level: int, hot: HotKeys, beta: float = BETA, rounds: int = ROUNDS) -> DataFrame:
    """(v, c): each vertex of ``edges`` (u, v) with the centre whose cluster reached it first.

    The edges hold both directions. A vertex's row in the state carries its best
    arrival time and the centre; a round sends it along its edges (a loop of
    weight 0 keeps the vertex's own) and keeps the least. The state stays
    partitioned by vertex, hub vertices are spread by ``salted_lookup``.
    """
    loops = edges.select("u").distinct()
    links = edges.select("u", "v", F.lit(1.0).alias("w")).unionByName(loops.select("u", F.col("u").alias("v"), F.lit(0.0).alias("w")))
    state = loops.select("u", (-_head_start("u", level, beta)).alias("at"), F.col("u").alias("c"))
    for _ in range(rounds):
        sent = salted_lookup(links, state, "u", hot, ["v"]).select("v", (F.col("at") + F.col("w")).alias("at"), "c")
        state = sent.groupBy("v").agg(F.min_by("c", "at").alias("c"), F.min("at").alias("at")).withColumnRenamed("v", "u")
    return state.select(F.col("u").alias("v"), "c")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def group_links(links: DataFrame, src: str = "src", dst: str = "dst", beta: float = BETA, rounds: int = ROUNDS, least: int = 50_000) -> DataFrame:
    """(id, group_id): the least id of all ids linked directly or indirectly.

    One row per id that occurs in a link. Links are undirected; repeated links and
    links of an id with itself count once (the latter still gives the id a row).
    Rows with a null end are left out; an empty table gives no rows; other columns
    of ``links``, whatever their names, are ignored.
    """
    spark = links.sparkSession
    raw = links.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).filter("u is not null and v is not null")
    pairs = materialize(raw.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    left = pairs.filter("u <> v")
    levels: list[DataFrame] = []
    while n := left.count():
        level = len(levels)
        graph = _both_ways(left)
        hot = hot_keys(graph, "u", least=least) if 2 * n > least else HotKeys()
        assigned = materialize(decompose(graph, level, hot, beta, rounds), f"clusters{level}")
        half = salted_lookup(left, assigned.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u", hot, ["v"]).select("cu", "v")
        both = salted_lookup(half, assigned.select("v", F.col("c").alias("cv")), "v", hot, ["cu"]).filter("cu <> cv")
        left = materialize(both.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct(), f"between{level}")
        levels.append(assigned)
    loners = pairs.filter("u = v").select(F.col("u").alias("id"), F.col("u").alias("group_id"))
    if not levels:
        return loners
    # upwards: the least original id in each cluster
    sizes: list[DataFrame] = []
    for assigned in levels:
        here = assigned.withColumn("m", F.col("v"))
        if sizes:
            here = assigned.join(sizes[-1].select(F.col("c").alias("v"), "m"), "v")
        sizes.append(materialize(here.groupBy("c").agg(F.min("m").alias("m"), F.count(F.lit(1)).alias("n")), "least"))
    # downwards: a super-vertex that no higher level holds is a whole group
    groups = None
    for assigned, own in zip(reversed(levels), reversed(sizes)):
        top = own.select("c", F.col("m").alias("group_id"))
        if groups is not None:
            above = groups.select(F.col("id").alias("c"), F.col("group_id").alias("g"))
            top = top.join(above, "c", "left").select("c", F.coalesce("g", "group_id").alias("group_id"))
        total = assigned.count()
        limit = hot_limit(spark, total, least)
        big = {r["c"]: r["n"] for r in own.filter(F.col("n") > limit).collect()} if total > limit else {}  # at most total / limit rows
        groups = salted_lookup(assigned, top, "c", HotKeys(total, limit, big), ["v"]).select(F.col("v").alias("id"), "group_id")
        if assigned is not levels[0]:
            groups = materialize(groups, "groups")
    return groups.unionByName(loners.join(pairs.filter("u <> v").select(F.explode(F.array("u", "v")).alias("id")), "id", "left_anti"))
