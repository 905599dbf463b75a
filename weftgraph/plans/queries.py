"""Graph queries: friends of friends, recommendations, subgraphs and their frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.vectors import dot
from weftgraph.operators.frontier import Frontier, group_by_count, without
from weftgraph.operators.lookup import among, id_frame, ids_of
from weftgraph.plans.traversal import path_frame, shortest_path


def friends_of_friends_excl(edges: DataFrame, vertex: int, etype: int | None, exclude_friends: bool = False) -> DataFrame:
    """(id, count): paths of two edges to each vertex but ``vertex`` itself; optionally without direct friends."""
    friends = Frontier.of(edges, vertex).traverse_out(etype)
    counts = group_by_count(friends.select_out(etype, F.col("dst") != vertex))
    return without(counts, friends) if exclude_friends else counts


def friends_of_friends_limited(edges: DataFrame, vertex: int, etype: int | None, most: int = 100, seed: int | None = None) -> DataFrame:
    """The same over at most ``most`` friends, drawn at random with a seed, else the least ids."""
    friends = Frontier.of(edges, vertex).traverse_out(etype).limit(most, seed)
    return group_by_count(friends.select_out(etype, F.col("dst") != vertex))


def friends_of_friends(edges: DataFrame, vertex: int, etype: int | None) -> DataFrame:
    """(id): vertices at the end of a walk of exactly two edges."""
    return Frontier.of(edges, vertex).traverse_out(etype).traverse_out(etype).ids


def recommend(counts: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` greatest counts; ties go to the smaller id."""
    return counts.orderBy(F.desc("count"), "id").limit(n)


def induced_subgraph(edges: DataFrame, ids, etype: int | None = None) -> DataFrame:
    """Edges with both ends in the set; parallel edges and self-loops are kept."""
    rows = edges if etype is None else edges.filter(F.col("etype") == etype)
    return among(among(rows, "src", ids), "dst", ids)


def ego_network(edges: DataFrame, vertex: int, etype: int | None = None) -> DataFrame:
    """(a, b): distinct undirected edges between the out-neighbours of a vertex, the vertex left out."""
    friends = Frontier.of(edges, vertex).traverse_out(etype).remove(Frontier.of(edges, vertex)).ids
    inside = induced_subgraph(edges, friends, etype)
    return inside.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()


def triple_frequencies(graphs: DataFrame) -> DataFrame:
    """(ego, n, edges0..edges3): how many vertex triples of each graph have 0 to 3 edges, exactly.

    ``graphs`` has (ego, a, b) with a < b, each edge once; the vertices are the
    ends of edges. From the vertices n, edges m, triangles T and the pairs of
    edges W that share an end: e3 = T, e2 = W - 3T, e1 = m(n-2) - 2 e2 - 3T.
    """
    two = graphs.select("ego", "a", "b")
    ends = two.select("ego", F.explode(F.array("a", "b")).alias("v"))
    degree = ends.groupBy("ego", "v").agg(F.count(F.lit(1)).alias("d"))
    basic = degree.groupBy("ego").agg(F.count(F.lit(1)).alias("n"), (F.sum("d") / 2).cast("bigint").alias("m"), F.sum((F.col("d") * (F.col("d") - 1) / 2).cast("bigint")).alias("w"))
    # edges point to the end of the greater degree, so no vertex has more than sqrt(2m) of them and hubs make no pairs of edges
    with_a = two.join(degree.select("ego", F.col("v").alias("a"), F.col("d").alias("da")), ["ego", "a"])
    both = with_a.join(degree.select("ego", F.col("v").alias("b"), F.col("d").alias("db")), ["ego", "b"])
    up = F.struct("da", "a") < F.struct("db", "b")
    out = both.select("ego", F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedges = out.join(out.select("ego", "x", F.col("y").alias("z")), ["ego", "x"]).filter("y < z").select("ego", F.col("y").alias("a"), F.col("z").alias("b"))
    triangles = wedges.join(two, ["ego", "a", "b"]).groupBy("ego").agg(F.count(F.lit(1)).alias("t"))
    all_in = basic.join(triangles, "ego", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    e2 = F.col("w") - 3 * F.col("t")
    e1 = F.col("m") * (F.col("n") - 2) - 2 * e2 - 3 * F.col("t")
    total = F.expr("n * (n - 1) * (n - 2) div 6")
    return all_in.select("ego", "n", (total - e1 - e2 - F.col("t")).alias("edges0"), e1.alias("edges1"), e2.alias("edges2"), F.col("t").alias("edges3"))


def ego_graphs(edges: DataFrame, egos: DataFrame, etype: int | None = None) -> DataFrame:
    """(ego, a, b): the ego networks of many vertices in one plan."""
    rows = (edges if etype is None else edges.filter(F.col("etype") == etype)).select("src", "dst").distinct()
    friends = rows.join(egos.select(F.col("id").alias("src")).distinct(), "src", "left_semi").filter("src <> dst").select(F.col("src").alias("ego"), F.col("dst").alias("v"))
    first = friends.withColumnRenamed("v", "src").join(rows, "src")
    both = first.join(friends.withColumnRenamed("v", "dst"), ["ego", "dst"], "left_semi")
    return both.select("ego", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()


def triple_distribution(edges: DataFrame, egos: DataFrame, etype: int | None = None) -> DataFrame:
    """Shares of triples with 0 to 3 edges for many egos; graphs of fewer than four vertices are left out."""
    counts = triple_frequencies(ego_graphs(edges, egos, etype)).filter("n >= 4")
    total = F.expr("n * (n - 1) * (n - 2) div 6")
    return counts.select("ego", *[(F.col(f"edges{k}") / total).alias(f"edges{k}") for k in range(4)])


def path_by_title(edges: DataFrame, dictionary: DataFrame, name: str, source: str, target: str, max_depth: int = 10) -> DataFrame:
    """(step, id, title) of a shortest path between two names; an unknown name raises."""
    spark = edges.sparkSession
    found = {r[name]: r["id"] for r in ids_of(spark.createDataFrame([(source,), (target,)], f"`{name}` string").distinct(), dictionary, name, strict=True).collect()}
    steps = path_frame(spark, shortest_path(edges, found[source], found[target], None, max_depth))
    return steps.join(dictionary.select("id", name), "id").select("step", "id", name)


def subgraph_by_titles(edges: DataFrame, dictionary: DataFrame, name: str, titles: list[str]) -> DataFrame:
    """Edges between named vertices; an unknown name raises."""
    spark = edges.sparkSession
    ids = ids_of(spark.createDataFrame([(t,) for t in titles], f"`{name}` string").distinct(), dictionary, name, strict=True)
    return induced_subgraph(edges, id_frame(spark, [r["id"] for r in ids.collect()]))


def recommend_by_factors(factors: DataFrame, user: int, items: DataFrame, n: int = 20) -> DataFrame:
    """(id, title, score): the ``items`` (id, title) of the greatest dot product with one user's factor.

    ``factors`` (id, factor) holds users and items; items without a factor are left
    out, those the user knows are not. The user's one row joins every item as a broadcast row.
    """
    one = F.broadcast(factors.filter(F.col("id") == user).select(F.col("factor").alias("_u")).limit(1))
    scored = items.select("id", "title").join(factors, "id").join(one).select("id", "title", dot(F.col("_u"), F.col("factor")).alias("score"))
    return scored.filter("score is not null").orderBy(F.desc("score"), "id").limit(n)
