"""Hand-checked graphs, edits, storage and codecs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph import registry
from weftgraph.functions import bits, vectors
from weftgraph.functions.ids import IdMap, intervals
from weftgraph.model import GraphSchema
from weftgraph.operators import lookup, mutation, sorting
from weftgraph.operators.frontier import Frontier, group_fold
from weftgraph.plans import compute, factorize, traversal
from weftgraph.plans import queries as graph
from weftgraph.sources import loaders
from weftgraph.sources.store import GraphStore


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(1, 2, 0, 10), (1, 2, 0, 11), (2, 3, 0, 12), (3, 4, 0, 13), (4, 4, 0, 14), (1, 5, 1, 15), (6, 7, 0, 16)]
    return spark.createDataFrame(rows, "src bigint, dst bigint, etype tinyint, edge_id bigint")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_neighbours(spark, edges):
    assert ids(lookup.query_out(edges, 1, 0), "neighbor_id") == [2, 2]
    assert ids(lookup.query_out(edges, 1, 9), "neighbor_id") == []
    assert ids(lookup.query_in(edges, 4, None), "neighbor_id") == [3, 4]
    assert lookup.find_edge(edges, 1, 2, 0).first()["edge_id"] == 11
    total = lookup.degrees(edges).agg(F.sum("out_degree"), F.sum("in_degree")).first()
    assert tuple(total) == (7, 7)
    with pytest.raises(ValueError):
        lookup.join_edge_columns(lookup.query_out(edges, 1, 0), edges, "nothing")


def test_frontier(edges):
    one = Frontier.of(edges, 1)
    hop = one.traverse_out(None)
    assert ids(hop.ids) == [2, 5]
    assert ids(hop.remove(Frontier.of(edges, 2)).ids) == [5]
    assert hop.has_vertex(5) and not hop.has_vertex(1)
    assert one.pipe(lambda f: f.traverse_out(0), lambda f: f.traverse_out(0)).size() == 1
    assert not Frontier.of(edges).has_any_vertex(one)


def test_paths(edges):
    assert traversal.shortest_path(edges, 1, 4) == [1, 2, 3, 4]
    assert traversal.shortest_path(edges, 1, 4, max_depth=2) == []
    assert traversal.shortest_path(edges, 4, 1) == []
    assert traversal.shortest_path(edges, 9, 9) == [9]
    assert traversal.shortest_path(edges, 1, 4, reverse=True) == [4, 3, 2, 1]
    tree = {r.id: (r.level, r.parent) for r in traversal.bfs(edges, 1).collect()}
    assert tree == {1: (0, 1), 2: (1, 1), 5: (1, 1), 3: (2, 2), 4: (3, 3)}


def test_shortest_paths_have_the_least_parents(spark):
    """From both ends the same path comes out as from the parents of a whole search."""
    import random

    r = random.Random(4)
    rows = [(r.randrange(60), r.randrange(60)) for _ in range(130)]
    graph_edges = spark.createDataFrame(rows, "src bigint, dst bigint")
    tree = traversal.bfs(graph_edges, 0)
    for target in (7, 23, 41, 58):
        assert traversal.shortest_path(graph_edges, 0, target, max_depth=20) == traversal.path_to(tree, target)[::-1]


def test_queries_over_all_egos_and_edges(spark, tmp_path):
    """An ego above 199 and edges of a weight above 5 are there in the whole queries."""
    lines = [(o, n, p, "A", 40.0) for o, way in enumerate([(900, 901, 902), (900, 902, 903), (901, 903), (900, 903)]) for n, p in enumerate(way, 1)]
    spark.createDataFrame(lines, "l_orderkey int, l_linenumber int, l_partkey bigint, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(p, "x", "y", 1) for p in (900, 901, 902, 903, 904)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert {r.ego for r in run("triple_freqs")} == {900, 901} and len(run("csv_sinks")) == 2
    assert [(r.component, r.size) for r in run("component_sizes")] == [(900, 4)]
    assert {r.id: r.label for r in run("min_label_program")} == {900: 900, 901: 900, 902: 900, 903: 900, 904: 904}
    assert {r.vertex: r.level1 for r in run("multi_bfs_hist")} == {900: 3, 901: 3, 902: 3, 903: 3, 904: 0}


def test_batches_of_hot_keys(spark):
    """Every answer comes once, in batches that a hot key and parallel edges cannot outgrow."""
    rows = [(1, d, 3, d) for d in range(2_500)] + [(1, 7, 3, 10_000 + k) for k in range(2_100)] + [(2, 9, 3, 1)]
    result = spark.createDataFrame(rows, "query_id bigint, neighbor_id bigint, etype int, edge_id bigint")
    got = lookup.batches(result).collect()
    assert max(len(r.neighbors) for r in got) <= 1_000 and all(r.neighbors == sorted(r.neighbors) for r in got)
    assert sorted((r.query_id, n) for r in got for n in r.neighbors) == sorted((q, n) for q, n, _, _ in rows)


@pytest.mark.parametrize("name", ["bfs_levels", "sssp_parents"])
def test_searches_run_to_the_end(spark, tmp_path, monkeypatch, name):
    """The registered searches follow a chain of twelve steps from part 7, over more levels than are kept apart."""
    monkeypatch.setattr(traversal, "MOST_TABLES", 5)
    lines = [(1, n, 6 + n, "A", 1.0) for n in range(1, 14)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = registry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.level) for r in rows) == [(7 + k, k) for k in range(13)]


def _searched(rows, seed, rounds=6):
    """{vertex: level} by brute force, over the edges in both directions."""
    near, level = {}, {seed: 0}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    edge = {seed}
    for k in range(1, rounds + 1):
        edge = {v for u in edge for v in near.get(u, ()) if v not in level}
        level |= dict.fromkeys(edge, k)
    return level


@pytest.fixture
def stored(monkeypatch):
    """The numbers of rows of the tables that searches write."""
    rows, measured = [], traversal.measured

    def counted(*args, **aggs):
        table, seen = measured(*args, **aggs)
        rows.append(seen.get("n") or 0)
        return table, seen

    monkeypatch.setattr(traversal, "measured", counted)
    return rows


def test_csv_levels_store_no_pairs(spark, tmp_path, stored):
    """150 searches over 150 parts store a row of bits for a vertex in a round, not one for each search that reaches it."""
    steps = [(k, (k + d) % 150) for k in range(150) for d in (1, 12, 40)]
    lines = [(o, n, p, "A", 1.0) for o, way in enumerate(steps) for n, p in enumerate(way, 1)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, "x", "y", 1) for p in range(150)], "p_partkey bigint, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.vertex: tuple(r[f"level{k}"] for k in range(1, 7)) for r in registry.queries()["csv_levels"](spark, str(tmp_path)).collect()}
    want = {p: list(_searched(steps, p).values()) for p in range(150)}
    assert got == {p: tuple(v.count(k) for k in range(1, 7)) for p, v in want.items()}
    assert stored and max(stored) <= 150


def test_many_searches(spark, monkeypatch, stored):
    """130 searches in three blocks of one word: levels and counts as by brute force, with a vertex's rows bounded by the blocks."""
    monkeypatch.setattr(traversal, "MOST_WORDS", 1, raising=False)
    monkeypatch.setattr(traversal, "MOST_TABLES", 3)
    rows = [(k, (k * k + 3) % 140) for k in range(140)] + [(k, (k + 9) % 140) for k in range(140)] + [(5, 5), (5, 14), (14, 5), (900, 901), (903, 903)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint")
    seeds = [*range(0, 125), 900, 902, 903, 10**15, -4]
    frame = spark.createDataFrame([(s,) for s in [*seeds, 7, 900]], "id bigint")
    want = {s: _searched(rows, s) for s in seeds}
    found = traversal.multi_bfs(edges, frame)
    assert sorted(map(tuple, found.select("seed", "id", "level").collect())) == sorted((s, v, k) for s, at in want.items() for v, k in at.items())
    assert stored and max(stored) <= 3 * len({v for row in rows for v in row} | set(seeds))
    counts = {(s, *(list(at.values()).count(k) for k in range(1, 7))) for s, at in want.items()}
    assert set(map(tuple, traversal.level_histogram(found).collect())) == counts
    table = traversal.searches(edges, frame).histogram()
    assert table.count() == len(seeds) and set(map(tuple, table.collect())) == counts
    assert traversal.multi_bfs(edges, frame.filter("id is null")).isEmpty()


def test_components_and_program(spark, edges):
    vertices = spark.range(1, 9)
    expected = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6, 8: 8}
    assert {r.id: r.component for r in compute.connected_components(vertices, edges).collect()} == expected
    assert {r.id: r.label for r in compute.run_program(compute.ReachableMin(), vertices, edges, 50).collect()} == expected
    chain = spark.createDataFrame([(i, i + 1) for i in range(40, 0, -1)], "src bigint, dst bigint")
    assert {r.component for r in compute.connected_components(spark.range(1, 42), chain).collect()} == {1}


def test_programs_write_edges(spark, edges):
    expected = {10: 1, 11: 1, 12: 1, 13: 1, 14: 1, 15: 1, 16: 6}
    state, labelled = compute.label_edges(spark.range(1, 9), edges)
    assert {r.edge_id: r.edge_label for r in labelled.collect()} == expected
    assert {r.id: r.label for r in state.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6, 8: 8}


class Waves(compute.ReachableMin):
    """Counts how often a vertex heard from an active neighbour; only scheduled vertices are active."""

    both_ways = False

    def init(self):
        return {"heard": F.lit(0)}

    def message(self):
        return {"got": F.lit(1)}

    def combine(self):
        return {"got": F.sum("got")}

    def apply(self):
        return {"heard": F.col("heard") + F.coalesce("got", F.lit(0))}

    def changed(self):
        return F.lit(False)

    def after_iteration(self, i, scheduler):
        if i == 0:
            scheduler.add_task(2)
            scheduler.add_tasks([3, 6])
        if i == 1:
            scheduler.add_task_to_all()


def test_scheduler(spark, edges):
    """All vertices in the first round, three in the second, all in the third, then none is left."""
    got = {r.id: r.heard for r in compute.run_program(Waves(), spark.range(1, 8), edges, 50).collect()}
    assert got == {1: 0, 2: 4, 3: 3, 4: 5, 5: 2, 6: 0, 7: 3}
    scheduler = compute.Scheduler()
    scheduler.add_task(1)
    assert scheduler.has_new_tasks() and scheduler.take(spark.range(3).withColumn("_active", F.lit(False))).filter("_active").collect()[0].id == 1
    assert not scheduler.has_new_tasks()


def test_folds(spark, edges):
    assert lookup.fold_values(edges.repartition(3), "edge_id", 0, lambda z, x: z ^ x, lambda a, b: a ^ b) == 10 ^ 11 ^ 12 ^ 13 ^ 14 ^ 15 ^ 16
    bag = edges.select(F.col("dst").alias("id"), F.col("edge_id").alias("v")).union(spark.createDataFrame([(2, None), (None, 4)], "id bigint, v bigint"))
    assert {r.id: r.value for r in group_fold(bag, "v", 0, max, max).collect()} == {2: 11, 3: 12, 4: 14, 5: 15, 7: 16}
    assert group_fold(bag.limit(0), "v", 0, max, max).collect() == []


def test_recommendations(spark):
    factors = spark.createDataFrame([(1, [1.0, 2.0]), (10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [0.0, 1.0])], "id bigint, factor array<double>")
    items = spark.createDataFrame([(10, "a"), (11, "b"), (12, None), (13, "d")], "id bigint, title string")
    assert [tuple(r) for r in graph.recommend_by_factors(factors, 1, items).collect()] == [(11, "b", 2.0), (12, None, 2.0), (10, "a", 1.0)]
    assert graph.recommend_by_factors(factors, 99, items).collect() == []


def test_large_ids_factorise(spark):
    far = 1 << 40
    ratings = spark.createDataFrame([(far + u, far * 2 + i, float((u * i) % 5)) for u in range(8) for i in range(6)], "src bigint, dst bigint, rating double")
    users, items = factorize.als(ratings, iterations=2, rank=2)
    assert ids(users) == [far + u for u in range(8)] and ids(items) == [far * 2 + i for i in range(6)]


def test_triples(spark):
    # a triangle with a tail, and six vertices checked by hand
    one = [(1, 1, 2), (1, 2, 3), (1, 1, 3), (1, 3, 4)]
    got = graph.triple_frequencies(spark.createDataFrame(one, "ego bigint, a bigint, b bigint")).first()
    assert (got.n, got.edges0, got.edges1, got.edges2, got.edges3) == (4, 0, 1, 2, 1)


def test_edits(edges):
    assert mutation.delete_edge(edges, 1, 2, 0).filter("src = 1 and dst = 2").first()["edge_id"] == 10
    assert mutation.delete_edge(edges, 9, 9, 0).count() == 7
    assert ids(mutation.delete_vertex(edges, 4), "edge_id") == [10, 11, 12, 15, 16]


def test_store(spark, edges, tmp_path):
    schema = GraphSchema().add("edge", "weight", "float").add("edge", "name", "string", default=lambda s, d, t: F.lit("new"))
    store = GraphStore(spark, f"file://{tmp_path}/g", schema, rows_per_file=2).create()
    with pytest.raises(FileExistsError):
        store.create()
    store.add_edges(edges.withColumn("weight", F.lit(1.5)), ["weight"])
    store.add_edges(spark.createDataFrame([(9, 1, 3, 99, None)], "src bigint, dst bigint, etype int, edge_id bigint, weight float"), ["weight"])
    assert store.update_edge(1, 2, 0, "name", "old") and not store.update_edge(5, 5, 0, "name", "x")
    assert store.update_edge(1, 2, 0, "name", "older") and store.update_edge(2, 3, 0, "weight", None)
    assert store.delete_edge(3, 4, 0) and not store.delete_edge(3, 4, 0)
    assert store.delete_vertex(6) and not store.delete_vertex(6)

    def state():
        return sorted((r.edge_id, r.weight, r.name) for r in store.edges().collect())

    before = state()
    assert before == [(10, 1.5, "new"), (11, 1.5, "older"), (12, None, "new"), (14, 1.5, "new"), (15, 1.5, "new"), (99, None, "new")]
    assert 0.2 < store.deleted_share() < 0.3
    running = store.edges()  # a reader from before the compaction
    assert not store.compact(0.9) and store.compact()
    assert state() == before and store.deleted_share() == 0
    assert running.count() == len(before)
    store.add_edges(edges.filter("edge_id = 10").withColumns({"edge_id": F.lit(777).cast("bigint"), "weight": F.lit(0.5)}), ["weight"], batch="s/1")
    store.add_edges(edges.withColumn("weight", F.lit(0.5)), ["weight"], batch="s/1")
    assert state() == sorted([*before, (777, 0.5, "new")])
    assert store.compact()
    store.add_edges(edges.withColumn("weight", F.lit(0.5)), ["weight"], batch="s/1")
    assert state() == sorted([*before, (777, 0.5, "new")])
    assert store.set_by_pointer(spark.createDataFrame([(777, "1.25"), (5, "1")], "edge_id bigint, value string"), "weight") == 2
    assert (777, 1.25, "new") in state()
    assert store.delete_edge(1, 2, 0) and store.delete_edge(1, 2, 0) and {x[0] for x in state()} == {10, 12, 14, 15, 99}
    assert ids(store.edges((2, 3)), "edge_id") == [10, 12]
    for v in (1, 2, 4, 5, 9):
        store.delete_vertex(v)
    assert store.compact() and state() == [] and store.add_edges(edges.withColumn("weight", F.lit(2.0)), ["weight"]) and len(state()) == 7
    with pytest.raises(ValueError):
        store.add_edges(edges, [])
    with pytest.raises(Exception, match="type from 0"):
        store.add_edges(spark.createDataFrame([(1, 1, 15, 5, 1.0)], "src bigint, dst bigint, etype int, edge_id bigint, weight float"), ["weight"])


def test_stored_vertices(spark, tmp_path):
    schema = GraphSchema().add("vertex", "title", "string").add("vertex", "year", "int")
    store = GraphStore(spark, f"file://{tmp_path}/v", schema).create()
    store.add_vertices(spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id bigint, title string, year int"))
    store.set_vertex_values(spark.createDataFrame([(1, "7"), (2, None), (3, "9")], "id bigint, value string"), "year")
    store.set_vertex_values(spark.createDataFrame([(1, "8")], "id bigint, value string"), "year")
    assert sorted(map(tuple, store.vertices().collect())) == [(1, "a", 8), (2, "b", None)]
    store.add_vertices(spark.createDataFrame([(1, "c", 3)], "id bigint, title string, year int"))
    assert sorted(map(tuple, store.vertices().collect())) == [(1, "c", 3), (2, "b", None)]
    with pytest.raises(KeyError):
        store.set_vertex_values(spark.createDataFrame([(1, "8")], "id bigint, value string"), "nothing")
    one, two = store._next(), store._next()
    assert one[:11] < two[:11]


def test_schema():
    with pytest.raises(ValueError):
        GraphSchema().add("edge", "c", "categorical")
    with pytest.raises(ValueError):
        GraphSchema().add("row", "c", "int")
    with pytest.raises(KeyError):
        GraphSchema().column("c", "edge")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-(1 << 31), (1 << 31) - 1), st.integers(-(1 << 31), (1 << 31) - 1)), min_size=1, max_size=50))
def test_bits(spark, pairs):
    df = spark.createDataFrame(pairs, "h bigint, l bigint")
    x = bits.pack32(F.col("h"), F.col("l"))
    for h, low, hh, ll, again in df.select("h", "l", bits.high32(x), bits.low32(x), bits.bytes_to_int(bits.int_to_bytes(F.col("l")))).collect():
        assert (h, low) == (hh, ll) and again == low


def test_ids(spark):
    m = IdMap(99_999, 44)
    rows = spark.range(0, 500_000, 777).select("id", m.backward(m.forward(F.col("id"))).alias("again")).collect()
    assert all(r.id == r.again for r in rows)
    assert intervals(9, 3) == [(0, 3), (4, 7), (8, 9)]


def test_arrays(spark):
    row = spark.createDataFrame([([1, 0, 3], [0, 2, 1], [3, 5, 9])], "a array<int>, b array<int>, s array<bigint>").select(
        vectors.closer(F.col("a"), F.col("b"), 2).alias("c"), vectors.increment(F.col("a"), 2, 2).alias("i"),
        vectors.lower_bound(F.col("s"), F.lit(8)).alias("l"), vectors.index_of(F.col("s"), F.lit(9)).alias("x"), vectors.index_of(F.col("s"), F.lit(4)).alias("y"),
        vectors.from_gaps(vectors.gaps(F.col("s"))).alias("s"), sorting.argsort(F.col("b")).alias("o"),
    ).first()
    assert (row.c, row.i, row.l, row.x, row.y, row.s, row.o) == ([1, 3, 2], [1, 0, 3], 1, 2, -1, [3, 5, 9], [0, 2, 1])


def test_order(spark):
    df = spark.createDataFrame([(v,) for v in (5, 3, 3, None, 9)], "v bigint")
    assert [sorting.quick_select(df, "v", n) for n in (0, 1, 2, 3, 4)] == [3, 3, 5, 9, None]
    ranked = sorting.rank_rows(spark.range(100).withColumn("v", F.col("id") % 7), "v", "id").collect()
    assert [r.id for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(range(100), key=lambda i: (i % 7, i))


def test_dictionary(spark):
    names = spark.createDataFrame([("a",), ("huuhaa",)], "title string")
    book = spark.createDataFrame([("a", 7)], "title string, id bigint")
    assert {r.title: r.id for r in lookup.ids_of(names, book, "title").collect()} == {"a": 7, "huuhaa": -1}
    with pytest.raises(Exception, match="unknown name"):
        lookup.ids_of(names, book, "title", strict=True).collect()


def test_loaders(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("# from to\n1\t2\n3\t4\t60\t0.5\nx\t5\n1\t2\n\n99999999999999999999\t1\n")
    path = f"file://{tmp_path}/e.tsv"
    loaded = loaders.read_edge_list(spark, path, bad="skip")
    assert sorted((r.src, r.dst) for r in loaded.collect()) == [(1, 2), (1, 2), (3, 4)]
    assert loaded.select("edge_id").distinct().count() == 3
    assert [(r.s, r.weight) for r in loaded.filter("src = 3").selectExpr("unix_seconds(ts) as s", "weight").collect()] == [(60, 0.5)]
    assert sorted(map(tuple, mutation.delete_edge(loaded, 1, 2, 0).select("src", "dst").collect())) == [(1, 2), (3, 4)]
    assert sorted(r.line for r in loaders.rejected_edges(spark, path).collect()) == ["99999999999999999999\t1", "x\t5"]
    with pytest.raises(Exception, match="bad line: "):
        loaders.read_edge_list(spark, path).collect()
    (tmp_path / "r.mm").write_text("%%MatrixMarket\n%\n3 3 2\n1 2 4\n2 1 9 5\n7 7\n")
    with pytest.raises(Exception, match="bad line: 7 7"):
        loaders.read_matrix_market(spark, f"file://{tmp_path}/r.mm").collect()
    assert sorted((r.src, r.dst, r.rating) for r in loaders.read_matrix_market(spark, f"file://{tmp_path}/r.mm", bad="skip").collect()) == [(200_001, 2, 4), (200_002, 1, 5)]
    (tmp_path / "t.csv").write_bytes("1,2001,Amélie, again\n2,NULL,X\nbad\n".encode("latin-1"))
    assert sorted((r.id, r.year, r.title) for r in loaders.read_titles(spark, f"file://{tmp_path}/t.csv", bad="skip").collect()) == [(1, 2001, "Amélie, again"), (2, 0, "X")]
    (tmp_path / "p.sql").write_text("ALTER TABLE x;\nINSERT INTO `page` VALUES (1,0,'A','x'),(2,1,'B\\'s (c),d',''),(3,0,'E','');\n")
    assert sorted(map(tuple, loaders.read_page_dump(spark, f"file://{tmp_path}/p.sql").collect())) == [(1, 0, "A"), (2, 1, "B's (c),d"), (3, 0, "E")]


def test_als_step(spark):
    ratings = spark.createDataFrame([(1, 10, 3.0), (1, 11, 1.0)], "src bigint, dst bigint, rating double")
    factors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0])], "id bigint, factor array<double>")
    got = factorize.als_step(ratings, factors).first()
    assert got.factor == pytest.approx([3 / 1.13, 1 / 1.13])
