"""Registered queries of the core and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import fixtures as fx
from weftgraph.functions import bits, vectors
from weftgraph.functions.ids import IdMap
from weftgraph.model import GraphSchema
from weftgraph.operators import hotkeys, lookup, mutation, sorting
from weftgraph.operators.edges import usable_edges
from weftgraph.operators.frontier import Frontier, group_by, group_by_count, without
from weftgraph.operators.frontier import group_fold as frontier_group_fold
from weftgraph.plans import compute, factorize, traversal
from weftgraph.plans import queries as graph
from weftgraph.session import materialize, micros, scratch_path
from weftgraph.sources import loaders, sinks
from weftgraph.sources.store import GraphStore
from weftgraph.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_USABLE = "src >= 1 AND dst >= 1 AND etype IS NOT NULL AND etype <> 15"
_E = f"E AS (SELECT DISTINCT src, dst, CAST(etype AS INT) AS etype, data_ptr AS edge_id, CAST(weight AS DOUBLE) AS weight, ts FROM result_edge WHERE {_USABLE})"
_V = """V AS (
  SELECT DISTINCT id, CASE WHEN lower(trim(vertextype)) IN ('user', 'movie') THEN lower(trim(vertextype)) END AS vtype, title, CAST(release_year AS INT) AS release_year FROM vertices
  UNION ALL SELECT id, 'page', title, NULL FROM page_title)"""
_P = """P AS (
  SELECT a.l_partkey AS src, b.l_partkey AS dst, CASE a.l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS etype, a.l_quantity AS weight
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""
_R = "R AS (SELECT o_custkey + 200000 AS src, l_partkey AS dst, l_quantity AS rating FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_HUBS = (792, 687, 274, 1879)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL with the same result."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _plain(df: DataFrame) -> DataFrame:
    """Types as in SQL: small integers as INT, floats as DOUBLE, timestamps as microseconds."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("tinyint", "smallint"):
            out.append(F.col(name).cast("int").alias(name))
        elif kind == "float":
            out.append(F.col(name).cast("double").alias(name))
        elif kind.startswith("timestamp"):
            out.append(micros(df, name).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


# --- hot keys ----------------------------------------------------------------


@query("p2_found", f"""
WITH e AS (SELECT DISTINCT src, dst, data_ptr, ts FROM result_edge WHERE {_USABLE} AND ts IS NOT NULL),
w AS (SELECT *, lag(data_ptr) OVER q AS p, lag(dst) OVER q AS pd, lag(ts) OVER q AS pt FROM e WINDOW q AS (PARTITION BY src ORDER BY ts, data_ptr))
SELECT least(p, data_ptr) AS data_ptr_1, greatest(p, data_ptr) AS data_ptr_2 FROM w WHERE pd = dst AND ts - pt <= INTERVAL 60 SECOND""")  # fmt: skip
def p2_found(spark: SparkSession, path: str) -> DataFrame:
    """Immediate repeats in each src's time order."""
    return hotkeys.immediate_repeats(fx.table(spark, path, "result_edge"))


@query("p2_quantiles", f"""
WITH e AS (SELECT src, epoch_us(ts) AS us FROM result_edge WHERE {_USABLE} AND ts IS NOT NULL)
SELECT src, count(*) AS n, quantile_disc(us, 0.25) AS q25, quantile_disc(us, 0.5) AS q50, quantile_disc(us, 0.75) AS q75 FROM e GROUP BY src""")  # fmt: skip
def p2_quantiles(spark: SparkSession, path: str) -> DataFrame:
    """Exact quartiles of the event time, in microseconds, of each src's deliveries."""
    edges = usable_edges(fx.table(spark, path, "result_edge"))
    rows = edges.filter("ts is not null").select("src", micros(edges, "ts").alias("us"))
    out = hotkeys.exact_quantiles(rows, "src", "us", [0.25, 0.5, 0.75])
    return out.select("src", "n", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))


# --- scans and lookups -------------------------------------------------------


@query("edge_scan", f"WITH {_E} SELECT src, dst, etype FROM E")
def edge_scan(spark, path):
    return _plain(lookup.sweep(fx.edge_table(spark, path)))


@query("edge_range_dst", f"WITH {_E} SELECT src, dst, etype, edge_id FROM E WHERE dst BETWEEN 500 AND 1500")
def edge_range_dst(spark, path):
    return _plain(lookup.sweep_in(fx.edge_table(spark, path), 500, 1_000_000, most=1_500, with_pointer=True))


@query("edge_range_src", f"WITH {_E} SELECT src, dst, etype, edge_id FROM E WHERE src BETWEEN 1 AND 1000")
def edge_range_src(spark, path):
    return _plain(lookup.sweep_out(fx.edge_table(spark, path), 1, 1_000))


@query("edges_from", f"WITH {_E} SELECT src, dst, edge_id FROM E WHERE src >= 1030000")
def edges_from(spark, path):
    return lookup.edges_from(fx.edge_table(spark, path), 1_030_000, in_order=True).select("src", "dst", "edge_id")


@query("query_out", f"WITH {_E} SELECT src AS query_id, dst AS neighbor_id, etype, edge_id FROM E WHERE src = 792 AND etype = 0")
def query_out(spark, path):
    return _plain(lookup.query_out(fx.edge_table(spark, path), 792, 0))


@query("query_in", f"WITH {_E} SELECT dst AS query_id, src AS neighbor_id, etype, edge_id FROM E WHERE dst = 1001 AND etype = 1")
def query_in(spark, path):
    return _plain(lookup.query_in(fx.edge_table(spark, path), 1001, 1))


@query("query_out_multi", f"WITH {_E} SELECT src AS query_id, dst AS neighbor_id, etype, edge_id FROM E WHERE src IN {_HUBS} AND etype = 2")
def query_out_multi(spark, path):
    return _plain(lookup.query_out(fx.edge_table(spark, path), list(_HUBS), 2))


@query("query_out_batches", f"""
WITH {_E}, b AS (
  SELECT src, dst, dst // 1024 AS block, (row_number() OVER (PARTITION BY src, dst // 1024 ORDER BY dst, edge_id) - 1) // 1000 AS part FROM E WHERE etype = 3)
SELECT src AS query_id, block, part, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbors FROM b GROUP BY src, block, part""")  # fmt: skip
def query_out_batches(spark, path):
    """The neighbours of every src, hot ones too, in bounded batches."""
    edges = fx.edge_table(spark, path)
    result = lookup.query_out(edges, edges.select(F.col("src").alias("id")), 3)
    return lookup.batches(result).withColumn("neighbors", F.array_join(F.col("neighbors").cast("array<string>"), ","))


@query("query_out_first5", f"""
WITH {_E} SELECT src AS query_id, dst AS neighbor_id, edge_id FROM E WHERE src IN {_HUBS} AND etype = 0
QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst, edge_id) <= 5""")  # fmt: skip
def query_out_first5(spark, path):
    return lookup.first_n(lookup.query_out(fx.edge_table(spark, path), list(_HUBS), 0), 5).select("query_id", "neighbor_id", "edge_id")


@query("degree", f"""
WITH {_E}, ends AS (SELECT src AS id, 0 AS i, 1 AS o FROM E UNION ALL SELECT dst, 1, 0 FROM E)
SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) + sum(o) AS BIGINT) AS degree FROM ends GROUP BY id""")  # fmt: skip
def degree(spark, path):
    return lookup.degrees(fx.edge_table(spark, path))


@query("graph_counts", f"WITH {_E}, {_V} SELECT (SELECT count(*) FROM E) AS edges, (SELECT count(*) FROM V) AS vertices, (SELECT count(*) FROM E WHERE src = dst) AS loops")
def graph_counts(spark, path):
    edges = fx.edge_table(spark, path).agg(F.count(F.lit(1)).alias("edges"), F.sum((F.col("src") == F.col("dst")).cast("bigint")).alias("loops"))
    return edges.crossJoin(fx.vertex_table(spark, path).agg(F.count(F.lit(1)).alias("vertices"))).select("edges", "vertices", "loops")


@query("edge_exists", f"WITH {_E} SELECT src, dst, etype, edge_id FROM E WHERE src = 792 AND dst = 1001 ORDER BY edge_id DESC LIMIT 1")
def edge_exists(spark, path):
    return _plain(lookup.find_edge(fx.edge_table(spark, path), 792, 1001, None).select("src", "dst", "etype", "edge_id"))


@query("edge_value", f"WITH {_E} SELECT edge_id, weight FROM E WHERE src = 792 AND dst = 1001 AND etype = 0 ORDER BY edge_id DESC LIMIT 1")
def edge_value(spark, path):
    return _plain(lookup.find_edge(fx.edge_table(spark, path), 792, 1001, 0).select("edge_id", "weight"))


@query("edge_pointer_values", f"WITH {_E} SELECT edge_id, weight FROM E WHERE edge_id IN (SELECT edge_id FROM E WHERE src = 687)")
def edge_pointer_values(spark, path):
    edges = fx.edge_table(spark, path)
    return _plain(lookup.by_pointer(edges, edges.filter("src = 687").select(F.col("edge_id").alias("id")), "weight"))


@query("vertex_value", f"WITH {_V} SELECT id, coalesce(title, '') AS title FROM V WHERE id = 792")
def vertex_value(spark, path):
    return lookup.value_of(fx.vertex_table(spark, path), "id", 792, "title", "")


@query("vertex_values", f"WITH {_V} SELECT id, title FROM V WHERE id IN {_HUBS}")
def vertex_values(spark, path):
    return lookup.values_of(fx.vertex_table(spark, path), "id", list(_HUBS), "title")


@query("vertex_select", f"WITH {_V} SELECT id, release_year FROM V WHERE release_year >= 2000")
def vertex_select(spark, path):
    return lookup.select_where(fx.vertex_table(spark, path), "release_year", F.col("release_year") >= 2000)


@query("vertex_update", f"WITH {_V} SELECT id, coalesce(release_year, 0) AS release_year FROM V")
def vertex_update(spark, path):
    return lookup.update_all(fx.vertex_table(spark, path), "release_year", F.coalesce("release_year", F.lit(0))).select("id", "release_year")


@query("vertex_fold", f"WITH {_V} SELECT count(release_year) AS n, min(release_year) AS lo, max(release_year) AS hi, CAST(sum(release_year) AS BIGINT) AS total FROM V")
def vertex_fold(spark, path):
    year = "release_year"
    return lookup.fold(fx.vertex_table(spark, path), n=F.count(year), lo=F.min(year), hi=F.max(year), total=F.sum(year))


@query("vertex_zero", f"WITH {_V} SELECT id, 0 AS release_year FROM V")
def vertex_zero(spark, path):
    return lookup.update_all(fx.vertex_table(spark, path), "release_year", F.lit(0)).select("id", "release_year")


@query("vertex_fold_custom", f"WITH {_V} SELECT CAST(sum(release_year * release_year) % 1000003 AS BIGINT) AS value FROM V")
def vertex_fold_custom(spark, path):
    """A fold by functions: squares modulo a prime."""
    value = lookup.fold_values(fx.vertex_table(spark, path), "release_year", 0, lambda z, x: (z + x * x) % 1_000_003, lambda a, b: (a + b) % 1_000_003)
    return spark.createDataFrame([(value,)], "value bigint")


@query("edge_set_pointer", f"WITH {_E} SELECT edge_id, CASE WHEN etype = 3 THEN 0.25 ELSE weight END AS weight FROM E")
def edge_set_pointer(spark, path):
    """A column set for many edges by their pointers."""
    edges = fx.edge_table(spark, path)
    return _plain(lookup.set_by_pointer(edges, edges.filter("etype = 3").select("edge_id", F.lit(0.25).alias("value")), "weight").select("edge_id", "weight"))


@query("index_guard", "SELECT TRUE AS refused")
def index_guard(spark, path):
    """An edge column does not join a result that is indexed by vertex, nor one that is no column."""
    edges = fx.edge_table(spark, path)
    refused = 0
    for result, column in ((edges.select(F.col("dst").alias("neighbor_id")), "weight"), (lookup.query_out(edges, 274, 0), "title")):
        try:
            lookup.join_edge_columns(result, edges, column)
        except ValueError:
            refused += 1
    return spark.createDataFrame([(refused == 2,)], "refused boolean")


_DOMAIN = ("user", "movie", "page")


@query("categorical_codec", f"WITH {_V} SELECT id, CASE vtype WHEN 'user' THEN 0 WHEN 'movie' THEN 1 WHEN 'page' THEN 2 END AS code, vtype AS name FROM V")
def categorical_codec(spark, path):
    coded = fx.vertex_table(spark, path).select("id", vectors.encode(F.col("vtype"), _DOMAIN).alias("code"))
    return coded.withColumn("name", vectors.decode(F.col("code"), _DOMAIN))


@query("dictionary", f"""
WITH names AS (SELECT DISTINCT title FROM vertices WHERE title IS NOT NULL UNION SELECT title FROM page_title WHERE title IS NOT NULL),
d AS (SELECT title, min(id) AS id FROM page_title GROUP BY title) SELECT names.title, coalesce(id, -1) AS id FROM names LEFT JOIN d USING (title)""")  # fmt: skip
def dictionary(spark, path):
    pages = fx.table(spark, path, "page_title")
    names = fx.table(spark, path, "vertices").select("title").union(pages.select("title")).filter("title is not null").distinct()
    return lookup.ids_of(names, pages.groupBy("title").agg(F.min("id").alias("id")), "title")


# --- joins -------------------------------------------------------------------


@query("edge_join_col", f"WITH {_E} SELECT DISTINCT dst AS neighbor_id, CASE WHEN NOT isnan(weight) THEN weight END AS weight FROM E WHERE src = 274 AND etype = 0")
def edge_join_col(spark, path):
    edges = fx.edge_table(spark, path)
    return _plain(lookup.join_edge_columns(lookup.query_out(edges, 274, 0), edges, "weight"))


@query("edge_join_two_cols", f"WITH {_E} SELECT DISTINCT dst AS neighbor_id, CASE WHEN NOT isnan(weight) THEN weight END AS weight, epoch_us(ts) AS ts FROM E WHERE src = 274 AND etype = 0")
def edge_join_two_cols(spark, path):
    edges = fx.edge_table(spark, path)
    return _plain(lookup.join_edge_columns(lookup.query_out(edges, 274, 0), edges, "weight", "ts"))


@query("vertex_join_col", f"WITH {_E}, {_V} SELECT id, title, vtype FROM V WHERE id IN (SELECT dst FROM E WHERE src = 274 AND etype = 0)")
def vertex_join_col(spark, path):
    result = lookup.query_out(fx.edge_table(spark, path), 274, 0)
    return lookup.join_vertex_columns(result, fx.vertex_table(spark, path), "title", "vtype")


@query("in_edges_src_join", f"""
WITH {_E}, {_V} SELECT src, dst, etype, vtype, release_year, CASE WHEN NOT isnan(weight) THEN weight END AS weight FROM E JOIN V ON src = id WHERE dst BETWEEN 1 AND 1200""")  # fmt: skip
def in_edges_src_join(spark, path):
    return _plain(lookup.sweep_in_join(fx.edge_table(spark, path), fx.vertex_table(spark, path), 1, 1_200, ["vtype", "release_year"], ["weight"]))


@query("map_out", f"WITH {_E} SELECT src AS query_id, dst * 10 + etype AS value FROM E WHERE src IN {_HUBS}")
def map_out(spark, path):
    return lookup.map_out(fx.edge_table(spark, path), list(_HUBS), None, F.col("dst") * 10 + F.col("etype"))


@query("title_join", f"""
WITH {_E}, d AS (SELECT title, min(id) AS id FROM page_title GROUP BY title)
SELECT e.src, d.id AS dst FROM E e JOIN page_title p ON e.dst = p.id JOIN d ON d.title = p.title WHERE e.src <> d.id""")  # fmt: skip
def title_join(spark, path):
    pages = fx.table(spark, path, "page_title")
    links = fx.edge_table(spark, path).join(pages.select(F.col("id").alias("dst"), "title"), "dst").select("src", F.lit(0).alias("ns"), "title")
    return loaders.resolve_links(links, pages)[0].select("src", "dst")


@query("title_unresolved", f"""
WITH {_E}, {_V} SELECT e.src, v.title FROM E e JOIN V v ON e.dst = v.id
WHERE v.title IS NULL OR v.title NOT IN (SELECT title FROM page_title WHERE title IS NOT NULL)""")  # fmt: skip
def title_unresolved(spark, path):
    links = fx.edge_table(spark, path).join(fx.vertex_table(spark, path).select(F.col("id").alias("dst"), "title"), "dst").select("src", F.lit(0).alias("ns"), "title")
    return loaders.resolve_links(links, fx.table(spark, path, "page_title"))[1]


# --- scalar functions --------------------------------------------------------


@query("bit_codec", f"""
WITH {_E} SELECT edge_id, ((edge_id & 4294967295) + 2147483648) % 4294967296 - 2147483648 AS lo, edge_id >> 32 AS hi, (edge_id >> 3) & 1 = 1 AS bit3, edge_id | 32 AS with5, edge_id AS again FROM E""")  # fmt: skip
def bit_codec(spark, path):
    x = F.col("edge_id")
    return fx.edge_table(spark, path).select(
        "edge_id", bits.low32(x).alias("lo"), bits.high32(x).alias("hi"), bits.get_bit(x, 3).alias("bit3"), bits.set_bit(x, 5).alias("with5"), bits.pack32(bits.high32(x), bits.low32(x)).alias("again")
    )


@query("packet_codec", f"""
WITH {_E} SELECT edge_id, src AS id, dst % 67108864 AS aux, CAST(etype AS BIGINT) AS etype, (src << 30) | ((dst % 67108864) << 4) | etype AS packet FROM E""")  # fmt: skip
def packet_codec(spark, path):
    packed = fx.edge_table(spark, path).select("edge_id", bits.pack_vertex(F.col("src"), F.col("dst"), F.col("etype")).alias("packet"))
    p = F.col("packet")
    return packed.select("edge_id", bits.packet_vertex(p).alias("id"), bits.packet_aux(p).alias("aux"), bits.packet_type(p).alias("etype"), "packet")


@query("pointer_codec", f"WITH {_E} SELECT edge_id, src % 256 AS shard, dst AS position, etype = 1 AS buffered FROM E")
def pointer_codec(spark, path):
    shard, at = F.col("src") % 256, F.col("dst")
    p = F.when(F.col("etype") == 1, bits.pack_buffer_pointer(shard, at)).otherwise(bits.pack_pointer(shard, at))
    packed = fx.edge_table(spark, path).select("edge_id", p.alias("p"))
    return packed.select("edge_id", bits.pointer_shard(F.col("p")).alias("shard"), bits.pointer_position(F.col("p")).alias("position"), bits.pointer_is_buffer(F.col("p")).alias("buffered"))


@query("bytes_codec", f"WITH {_E} SELECT DISTINCT src, lower(printf('%08x', src)) AS hex FROM E")
def bytes_codec(spark, path):
    made = fx.edge_table(spark, path).select("src").distinct().withColumn("b", bits.int_to_bytes(F.col("src")))
    return made.select(bits.bytes_to_int(F.col("b")).cast("bigint").alias("src"), F.lower(F.hex("b")).alias("hex"))


@query("id_translate", f"WITH {_V} SELECT id, (id % 44) * 99999 + id // 44 AS internal, id AS original FROM V")
def id_translate(spark, path):
    ids = IdMap.from_string(IdMap(99_999, 44).to_string())
    moved = fx.vertex_table(spark, path).select("id", ids.forward(F.col("id")).alias("internal"))
    return moved.withColumn("original", ids.backward(F.col("internal")))


@query("counters", """
WITH c AS (SELECT callback_id, any_value(edge_types) AS t FROM (SELECT callback_id, list_sort(edge_types) AS edge_types FROM query_callback WHERE edge_types IS NOT NULL) GROUP BY callback_id),
x AS (SELECT callback_id, list_transform(t, lambda v: coalesce(v, 0)) AS t FROM c)
SELECT callback_id,
  array_to_string(list_transform(t, lambda v: least(v + 1, 3)), ',') AS up,
  array_to_string(list_transform(t, lambda v: CASE WHEN v = 0 THEN 0 ELSE least(v + 1, 3) END), ',') AS up_nonzero,
  array_to_string(list_transform(t, lambda v: CASE WHEN v = 0 THEN 0 ELSE v END), ',') AS closer FROM x""")  # fmt: skip
def counters(spark, path):
    sorted_types = fx.table(spark, path, "query_callback").filter("edge_types is not null").select("callback_id", F.sort_array("edge_types").alias("t"))
    held = sorted_types.dropDuplicates(["callback_id"]).select("callback_id", F.transform("t", lambda v: F.coalesce(v, F.lit(0)).cast("int")).alias("t"))

    def text(c):
        return F.array_join(c.cast("array<string>"), ",")

    t = F.col("t")
    return held.select("callback_id", text(vectors.increment_all(t, 2)).alias("up"), text(vectors.increment_nonzero(t, 2)).alias("up_nonzero"), text(vectors.closer(t, t, 2)).alias("closer"))


@query("sequence_gaps", """
WITH s AS (SELECT callback_id, any_value(s) AS s FROM (SELECT callback_id, list_sort(list_distinct(list_filter(neighbor_ids, lambda x: x >= 1))) AS s FROM query_callback WHERE neighbor_ids IS NOT NULL) GROUP BY callback_id)
SELECT callback_id, array_to_string(list_transform(s, lambda x, i: x - CASE WHEN i > 1 THEN s[i - 1] ELSE 0 END), ',') AS gaps,
  array_to_string(s, ',') AS again, len(list_filter(s, lambda x: x <= 1000)) - 1 AS at FROM s""")  # fmt: skip
def sequence_gaps(spark, path):
    rows = fx.table(spark, path, "query_callback").filter("neighbor_ids is not null")
    s = F.array_sort(F.array_distinct(F.filter("neighbor_ids", lambda x: x >= 1)))
    held = rows.select("callback_id", s.alias("s")).dropDuplicates(["callback_id"])

    def text(c):
        return F.array_join(c.cast("array<string>"), ",")

    coded = held.withColumn("g", vectors.gaps(F.col("s")))
    return coded.select("callback_id", text(F.col("g")).alias("gaps"), text(vectors.from_gaps(F.col("g"))).alias("again"), vectors.lower_bound(F.col("s"), F.lit(1_000)).alias("at"))


@query("vector_dot", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm FROM embeddings")
def vector_dot(spark, path):
    v = F.col("embedding").cast("array<double>")
    return fx.table(spark, path, "embeddings").select("vec_id", F.round(vectors.dot(v, v), 4).alias("norm"))


# --- traversal ---------------------------------------------------------------

_HOP = "SELECT DISTINCT dst FROM P WHERE etype = 0 AND src = 7"


@query("traverse_out", f"WITH {_P} SELECT DISTINCT dst AS id FROM P WHERE etype = 0 AND src = 7")
def traverse_out(spark, path):
    return Frontier.of(fx.part_edges(spark, path), 7).traverse_out(0).ids


@query("traverse_out_fn", f"WITH {_P} SELECT DISTINCT dst // 2 AS id FROM P WHERE etype = 1 AND src IN (7, 8, 9) AND dst % 3 <> 0")
def traverse_out_fn(spark, path):
    start = Frontier.of(fx.part_edges(spark, path), 7, 8, 9)
    return start.traverse_out(1, F.col("dst") % 3 != 0, F.call_function("div", F.col("dst"), F.lit(2))).ids


@query("traverse_out_until", f"WITH {_P} SELECT DISTINCT dst AS id, (SELECT count(*) > 0 FROM P WHERE etype = 0 AND src = 7 AND dst % 2 = 0) AS stopped FROM P WHERE etype = 0 AND src = 7")
def traverse_out_until(spark, path):
    step, stopped = Frontier.of(fx.part_edges(spark, path), 7).traverse_out_until(0, F.col("dst") % 2 == 0)
    return step.ids.withColumn("stopped", F.lit(stopped))


@query("frontier_union", f"WITH {_P} SELECT dst AS id FROM P WHERE etype = 0 AND src = 7 UNION SELECT dst FROM P WHERE etype = 1 AND src = 7 UNION SELECT 5")
def frontier_union(spark, path):
    start = Frontier.of(fx.part_edges(spark, path), 7)
    return start.traverse_out(0).union(start.traverse_out(1)).insert(5).ids


@query("frontier_remove", f"WITH {_P} SELECT DISTINCT dst AS id FROM P WHERE src IN ({_HOP}) AND dst NOT IN ({_HOP})")
def frontier_remove(spark, path):
    hop = Frontier.of(fx.part_edges(spark, path), 7).traverse_out(0)
    return hop.traverse_out(None).remove(hop).ids


@query("frontier_intersect", f"WITH {_P} SELECT DISTINCT dst AS id FROM P WHERE src BETWEEN 0 AND 20 INTERSECT SELECT DISTINCT dst FROM P WHERE src BETWEEN 21 AND 40")
def frontier_intersect(spark, path):
    edges = fx.part_edges(spark, path)
    return Frontier.of(edges, *range(21)).traverse_out(None).intersect(Frontier.of(edges, *range(21, 41)).traverse_out(None)).ids


@query("frontier_limit", f"WITH {_P} SELECT DISTINCT dst AS id FROM P WHERE src BETWEEN 0 AND 20 ORDER BY id LIMIT 10")
def frontier_limit(spark, path):
    return Frontier.of(fx.part_edges(spark, path), *range(21)).traverse_out(None).limit(10).ids


@query("select_out_count", f"WITH {_P} SELECT dst AS id, count(*) AS count FROM P WHERE src IN ({_HOP}) AND dst > 100 GROUP BY dst")
def select_out_count(spark, path):
    hop = Frontier.of(fx.part_edges(spark, path), 7).traverse_out(0)
    return group_by_count(hop.select_out(None, F.col("dst") > 100))


@query("group_by_minus", f"""
WITH {_P} SELECT dst AS id, count(*) AS n, CAST(sum(dst % 7) AS BIGINT) AS total FROM P WHERE src IN ({_HOP}) AND dst NOT IN ({_HOP}) GROUP BY dst""")  # fmt: skip
def group_by_minus(spark, path):
    hop = Frontier.of(fx.part_edges(spark, path), 7).traverse_out(0)
    return without(group_by(hop.select_out(None), n=F.count(F.lit(1)), total=F.sum(F.col("id") % 7)), hop)


@query("group_fold", f"WITH {_P} SELECT dst AS id, CAST(sum(dst * dst + 1) % 65521 AS BIGINT) AS value FROM P WHERE src IN ({_HOP}) GROUP BY dst")
def group_fold(spark, path):
    """A fold by functions for each emitted vertex."""
    bag = Frontier.of(fx.part_edges(spark, path), 7).traverse_out(0).select_out(None)
    return frontier_group_fold(bag.withColumn("x", F.col("id")), "x", 0, lambda z, x: (z + x * x + 1) % 65_521, lambda a, b: (a + b) % 65_521)


# --- graph queries -----------------------------------------------------------


@query("fof", f"WITH {_P} SELECT DISTINCT dst AS id FROM P WHERE etype = 0 AND src IN ({_HOP})")
def fof(spark, path):
    return graph.friends_of_friends(fx.part_edges(spark, path), 7, 0)


@query("fof_excl", f"WITH {_P} SELECT dst AS id, count(*) AS count FROM P WHERE etype = 0 AND src IN ({_HOP}) AND dst <> 7 GROUP BY dst")
def fof_excl(spark, path):
    return graph.friends_of_friends_excl(fx.part_edges(spark, path), 7, 0)


@query("fof_excl_friends", f"WITH {_P} SELECT dst AS id, count(*) AS count FROM P WHERE etype = 0 AND src IN ({_HOP}) AND dst <> 7 AND dst NOT IN ({_HOP}) GROUP BY dst")
def fof_excl_friends(spark, path):
    return graph.friends_of_friends_excl(fx.part_edges(spark, path), 7, 0, exclude_friends=True)


@query("fof_limited", f"WITH {_P} SELECT dst AS id, count(*) AS count FROM P WHERE etype = 0 AND src IN (SELECT * FROM ({_HOP}) ORDER BY 1 LIMIT 3) AND dst <> 7 GROUP BY dst")
def fof_limited(spark, path):
    return graph.friends_of_friends_limited(fx.part_edges(spark, path), 7, 0, 3)


@query("recommend_top20", f"""
WITH {_E}, hop AS (SELECT DISTINCT dst FROM E WHERE etype = 0 AND src = 274)
SELECT dst AS id, count(*) AS count FROM E WHERE etype = 0 AND src IN (SELECT dst FROM hop) AND dst <> 274 GROUP BY dst ORDER BY count DESC, id LIMIT 20""")  # fmt: skip
def recommend_top20(spark, path):
    return graph.recommend(graph.friends_of_friends_excl(fx.edge_table(spark, path), 274, 0))


@query("recommend_limited", f"WITH {_P} SELECT dst AS id, count(*) AS count FROM P WHERE etype = 0 AND src IN (SELECT * FROM ({_HOP}) ORDER BY 1 LIMIT 5) AND dst <> 7 GROUP BY dst ORDER BY count DESC, id LIMIT 20")
def recommend_limited(spark, path):
    return graph.recommend(graph.friends_of_friends_limited(fx.part_edges(spark, path), 7, 0, 5))


@query("induced_subgraph", f"WITH {_P}, s AS ({_HOP} UNION SELECT dst FROM P WHERE etype = 0 AND src IN ({_HOP})) SELECT src, dst, etype FROM P WHERE src IN (SELECT dst FROM s) AND dst IN (SELECT dst FROM s)")
def induced_subgraph(spark, path):
    edges = fx.part_edges(spark, path)
    hop = Frontier.of(edges, 7).traverse_out(0)
    return graph.induced_subgraph(edges, hop.union(hop.traverse_out(0)).ids).select("src", "dst", "etype")


_EGO = "ego AS (SELECT DISTINCT dst FROM E WHERE src = 274 AND dst <> 274), g AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM E WHERE src <> dst AND src IN (SELECT dst FROM ego) AND dst IN (SELECT dst FROM ego))"


@query("ego_network", f"WITH {_E}, {_EGO} SELECT a, b FROM g")
def ego_network(spark, path):
    return graph.ego_network(fx.edge_table(spark, path), 274)


_TRIPLES = """friends AS (SELECT DISTINCT e.src AS ego, e.dst AS v FROM P e WHERE e.src <> e.dst),
g AS (SELECT DISTINCT f.ego, least(p.src, p.dst) AS a, greatest(p.src, p.dst) AS b FROM friends f JOIN P p ON p.src = f.v JOIN friends h ON h.ego = f.ego AND h.v = p.dst WHERE p.src <> p.dst),
deg AS (SELECT ego, v, count(*) AS d FROM (SELECT ego, a AS v FROM g UNION ALL SELECT ego, b FROM g) GROUP BY ego, v),
base AS (SELECT ego, count(*) AS n, CAST(sum(d) // 2 AS BIGINT) AS m, CAST(sum(d * (d - 1) // 2) AS BIGINT) AS w FROM deg GROUP BY ego),
tri AS (SELECT x.ego, count(*) AS t FROM g x JOIN g y ON x.ego = y.ego AND x.b = y.a JOIN g z ON z.ego = x.ego AND z.a = x.a AND z.b = y.b GROUP BY x.ego),
f AS (SELECT ego, n, coalesce(t, 0) AS e3, w - 3 * coalesce(t, 0) AS e2, m, n * (n - 1) * (n - 2) // 6 AS c FROM base LEFT JOIN tri USING (ego)),
q AS (SELECT ego, n, e3, e2, m * (n - 2) - 2 * e2 - 3 * e3 AS e1, c FROM f)"""


_LEVELS = """L(id, level) USING KEY (id) AS (
  SELECT CAST(7 AS BIGINT), 0
  UNION SELECT p.dst, min(L.level) + 1 FROM L JOIN P p ON p.src = L.id AND p.etype = 0 LEFT JOIN recurring.L AS k ON k.id = p.dst WHERE k.id IS NULL GROUP BY p.dst),
B AS (SELECT id, level FROM L)"""


@query("bfs_levels", f"WITH RECURSIVE {_P}, {_LEVELS} SELECT id, level FROM B")
def bfs_levels(spark, path):
    return traversal.bfs(fx.part_edges(spark, path), 7, 0).select("id", "level")


@query("sssp_parents", f"""
WITH RECURSIVE {_P}, {_LEVELS} SELECT b.id, b.level, coalesce(min(a.id), 7) AS parent
FROM B b LEFT JOIN P p ON p.dst = b.id AND p.etype = 0 AND b.level > 0 LEFT JOIN B a ON a.id = p.src AND a.level = b.level - 1 GROUP BY b.id, b.level""")  # fmt: skip
def sssp_parents(spark, path):
    return traversal.bfs(fx.part_edges(spark, path), 7, 0)


@query("shortest_path", f"""
WITH RECURSIVE {_P}, {_LEVELS}, W(id, level) AS (
  SELECT id, level FROM B WHERE id = 19
  UNION ALL SELECT (SELECT min(a.id) FROM P p JOIN B a ON a.id = p.src AND a.level = W.level - 1 WHERE p.dst = W.id AND p.etype = 0), W.level - 1 FROM W WHERE W.level > 0)
SELECT level AS step, id FROM W""")  # fmt: skip
def shortest_path(spark, path):
    return traversal.path_frame(spark, traversal.shortest_path(fx.part_edges(spark, path), 7, 19, 0, max_depth=8))


@query("multi_bfs_hist", f"""
WITH RECURSIVE {_P}, S AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM P UNION ALL SELECT dst, src FROM P)),
M(seed, id, level) USING KEY (seed, id) AS (
  SELECT p_partkey, p_partkey, 0 FROM (SELECT p_partkey FROM part ORDER BY 1 LIMIT 1200)
  UNION SELECT M.seed, S.dst, min(M.level) + 1 FROM M JOIN S ON S.src = M.id LEFT JOIN recurring.M AS k ON k.seed = M.seed AND k.id = S.dst
  WHERE k.id IS NULL AND M.level < 6 GROUP BY M.seed, S.dst)
SELECT seed AS vertex, {', '.join(f'count(*) FILTER (level = {k}) AS level{k}' for k in range(1, 7))} FROM M GROUP BY seed""")
def multi_bfs_hist(spark, path):
    """Levels around the 1,200 least parts over all edges."""
    seeds = fx.part_vertices(spark, path).select("id").orderBy("id").limit(1_200)
    return traversal.searches(fx.part_edges(spark, path), seeds).histogram()


@query("csv_levels", ORACLES["multi_bfs_hist"])
def csv_levels(spark, path):
    """The same levels written as CSV and read back."""
    target = scratch_path(spark, "csv")
    sinks.write_level_histogram(multi_bfs_hist(spark, path), target)
    return spark.read.option("header", True).schema("vertex bigint, " + ", ".join(f"level{k} bigint" for k in range(1, 7))).csv(target)


def _egos(spark: SparkSession, path: str) -> DataFrame:
    return fx.part_edges(spark, path).select(F.col("src").alias("id"))


@query("triple_freqs", f"WITH {_P}, {_TRIPLES} SELECT ego, n, c - e1 - e2 - e3 AS edges0, e1 AS edges1, e2 AS edges2, e3 AS edges3 FROM q")
def triple_freqs(spark, path):
    return graph.triple_frequencies(graph.ego_graphs(fx.part_edges(spark, path), _egos(spark, path)))


@query("triple_distribution", f"""
WITH {_P}, {_TRIPLES} SELECT ego, round((c - e1 - e2 - e3) / c, 6) AS edges0, round(e1 / c, 6) AS edges1, round(e2 / c, 6) AS edges2, round(e3 / c, 6) AS edges3 FROM q WHERE n >= 4""")  # fmt: skip
def triple_distribution(spark, path):
    out = graph.triple_distribution(fx.part_edges(spark, path), _egos(spark, path))
    return out.select("ego", *[F.round(f"edges{k}", 6).alias(f"edges{k}") for k in range(4)])


@query("csv_sinks", f"WITH {_P}, {_TRIPLES} SELECT c - e1 - e2 - e3 AS edges0, e1 AS edges1, e2 AS edges2, e3 AS edges3 FROM q")
def csv_sinks(spark, path):
    """Triple frequencies of every ego written as CSV and read back."""
    target = scratch_path(spark, "csv")
    sinks.write_triple_frequencies(triple_freqs(spark, path), target)
    return spark.read.option("header", True).schema("edges0 bigint, edges1 bigint, edges2 bigint, edges3 bigint").csv(target)


# --- vertex programs ---------------------------------------------------------

_CC = """links AS (SELECT src AS a, dst AS b FROM P UNION SELECT dst, src FROM P),
label(v, g) USING KEY (v) AS (
  SELECT p_partkey AS v, p_partkey AS g FROM part
  UNION SELECT e.b, min(l.g) FROM label l JOIN links e ON e.a = l.v JOIN recurring.label k ON k.v = e.b WHERE l.g < k.g GROUP BY e.b)"""


@query("components", f"WITH RECURSIVE {_P}, {_CC} SELECT v AS id, g AS component FROM label")
def components(spark, path):
    """Components over all part edges."""
    return compute.connected_components(fx.part_vertices(spark, path), fx.part_edges(spark, path))


@query("component_sizes", f"WITH RECURSIVE {_P}, {_CC} SELECT g AS component, count(*) AS size FROM label GROUP BY g HAVING count(*) > 1 ORDER BY size DESC, component DESC LIMIT 20")
def component_sizes(spark, path):
    return compute.component_sizes(components(spark, path))


@query("min_label_program", f"WITH RECURSIVE {_P}, {_CC} SELECT v AS id, g AS label FROM label")
def min_label_program(spark, path):
    """The same components by the vertex program, until no vertex is active."""
    return compute.run_program(compute.ReachableMin(), fx.part_vertices(spark, path), fx.part_edges(spark, path), 1_000_000)


@query("edge_labels", f"WITH RECURSIVE {_P}, {_CC} SELECT src, dst, etype, weight, g AS edge_label FROM P JOIN label ON v = src")
def edge_labels(spark, path):
    """Component labels as a program that reads and writes edge values leaves them on the edges."""
    return compute.label_edges(fx.part_vertices(spark, path), fx.part_edges(spark, path))[1].withColumn("weight", F.col("weight").cast("double"))


def _rank_round(k: int, last: str) -> str:
    return f"""r{k} AS (SELECT v.p_partkey AS id, 0.15 / n.n + 0.85 * coalesce(sum(greatest(CAST(0.15 AS DOUBLE), {last}.rank) / o.d), 0) AS rank
FROM part v CROSS JOIN n LEFT JOIN P e ON e.dst = v.p_partkey LEFT JOIN {last} ON {last}.id = e.src LEFT JOIN o ON o.src = e.src GROUP BY v.p_partkey, n.n)"""


@query("pagerank3", f"""
WITH {_P}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM part), o AS (SELECT src, CAST(count(*) AS DOUBLE) AS d FROM P GROUP BY src),
r0 AS (SELECT p_partkey AS id, CAST(0 AS DOUBLE) AS rank FROM part), {_rank_round(1, 'r0')}, {_rank_round(2, 'r1')}, {_rank_round(3, 'r2')}
SELECT id, round(rank, 6) AS rank FROM r3""")  # fmt: skip
def pagerank3(spark, path):
    return compute.pagerank(fx.part_vertices(spark, path), fx.part_edges(spark, path), 3).select("id", F.round("rank", 6).alias("rank"))


def _factors(ids: DataFrame) -> DataFrame:
    """Fixed factors, so that the results can be checked: entry k of id is ((31 id + 17 k) mod 97) / 97."""
    return ids.select("id", F.array(*[((F.col("id") * 31 + 17 * k) % 97) / F.lit(97.0) for k in range(factorize.RANK)]).alias("factor"))


def _f(of: str, k: int) -> str:
    return f"((({of}) * 31 + {17 * k}) % 97) / 97.0::DOUBLE"


_SCORE = " + ".join(f"({_f('u', k)}) * ({_f('i', k)})" for k in range(10))


@query("als_predict", f"SELECT i AS id, round({_SCORE}, 6) AS score FROM (SELECT 200011 AS u, p_partkey AS i FROM part) ORDER BY round({_SCORE}, 9) DESC, id LIMIT 20")
def als_predict(spark, path):
    items = fx.part_vertices(spark, path).select("id", F.col("name").alias("title"))
    factors = _factors(items.select("id").union(spark.createDataFrame([(200_011,)], "id bigint")))
    return graph.recommend_by_factors(factors, 200_011, items).select("id", F.round("score", 6).alias("score"))


@query("recommend_for_user", f"WITH {_V} SELECT i AS id, title, round({_SCORE}, 6) AS score FROM (SELECT 1000033 AS u, id AS i, title FROM V WHERE vtype = 'movie') ORDER BY round({_SCORE}, 9) DESC, id LIMIT 20")
def recommend_for_user(spark, path):
    """The 20 movies of the greatest score, with their titles."""
    vertices = fx.vertex_table(spark, path)
    factors = _factors(vertices.select("id").union(spark.createDataFrame([(1_000_033,)], "id bigint")).distinct())
    return graph.recommend_by_factors(factors, 1_000_033, vertices.filter("vtype = 'movie'")).select("id", "title", F.round("score", 6).alias("score"))


@query("als_rmse", f"WITH {_R}, s AS (SELECT rating, {_SCORE} AS p FROM (SELECT src AS u, dst AS i, rating FROM R)) SELECT count(*) AS n, round(sqrt(avg((rating - p) * (rating - p))), 6) AS rmse FROM s")
def als_rmse(spark, path):
    rows = fx.ratings(spark, path)
    users = _factors(rows.select(F.col("src").alias("id")).distinct())
    items = _factors(rows.select(F.col("dst").alias("id")).distinct())
    return factorize.rmse(factorize.predict(rows, users, items)).select("n", F.round("rmse", 6).alias("rmse"))


_SUMS = [(f"a{i}_{j}", f"x{i} * x{j}") for i in range(10) for j in range(i, 10)] + [(f"b{i}", f"x{i} * rating") for i in range(10)]


@query("als_normal", f"""
WITH {_R}, x AS (SELECT src AS id, rating, {', '.join(f'{_f("dst", k)} AS x{k}' for k in range(10))} FROM R)
SELECT id, count(*) AS n, {', '.join(f'round(sum({e}), 6) AS {c}' for c, e in _SUMS)} FROM x GROUP BY id""")  # fmt: skip
def als_normal(spark, path):
    rows = fx.ratings(spark, path)
    out = factorize.normal_equations(rows, _factors(rows.select(F.col("dst").alias("id")).distinct()), "src")
    return out.select("id", "n", *[F.round(c, 6).alias(c) for c, _ in _SUMS])


@query("als_solved", f"WITH {_R} SELECT src AS id, TRUE AS solved FROM R GROUP BY src")
def als_solved(spark, path):
    """Whether each user's factor of a step solves its equations (A + 0.065 n I) w = b."""
    rows = fx.ratings(spark, path)
    given = _factors(rows.select(F.col("dst").alias("id")).distinct())
    both = factorize.normal_equations(rows, given, "src").join(factorize.als_step(rows, given, "src"), "id")
    w = [F.get("factor", F.lit(k)) for k in range(factorize.RANK)]
    a = {(i, j): F.col(f"a{min(i, j)}_{max(i, j)}") for i in range(factorize.RANK) for j in range(factorize.RANK)}
    rest = [F.abs(sum(a[i, j] * w[j] for j in range(factorize.RANK)) + factorize.LAMBDA * F.col("n") * w[i] - F.col(f"b{i}")) for i in range(factorize.RANK)]
    return both.select("id", (F.greatest(*rest) < 1e-6).alias("solved"))


@query("als_better", f"WITH {_R} SELECT count(*) AS n, TRUE AS better FROM R")
def als_better(spark, path):
    """Whether training explains the ratings better than their mean does."""
    rows = fx.ratings(spark, path)
    users, items = factorize.als(rows)
    spread = rows.agg(F.stddev_pop("rating").alias("spread"))
    return factorize.rmse(factorize.predict(rows, users, items)).crossJoin(F.broadcast(spread)).select("n", (F.col("rmse") < F.col("spread")).alias("better"))


# --- edits, storage and streams ----------------------------------------------


@query("delete_edge", f"WITH {_E} SELECT src, dst, edge_id FROM E WHERE edge_id <> (SELECT max(edge_id) FROM E WHERE src = 792 AND dst = 1001)")
def delete_edge(spark, path):
    return mutation.delete_edge(fx.edge_table(spark, path), 792, 1001, None).select("src", "dst", "edge_id")


@query("delete_vertex", f"WITH {_E} SELECT src, dst, edge_id FROM E WHERE src <> 792 AND dst <> 792")
def delete_vertex(spark, path):
    return mutation.delete_vertex(fx.edge_table(spark, path), 792).select("src", "dst", "edge_id")


@query("update_edge", f"WITH {_E} SELECT edge_id, CASE WHEN edge_id = (SELECT max(edge_id) FROM E WHERE src = 792 AND dst = 1001) THEN 0.5 ELSE weight END AS weight FROM E")
def update_edge(spark, path):
    return _plain(mutation.update_edge(fx.edge_table(spark, path), 792, 1001, None, "weight", 0.5).select("edge_id", "weight"))


@query("tombstones", f"WITH {_E} SELECT edge_id FROM E WHERE edge_id NOT IN (SELECT edge_id FROM E WHERE etype = 3)")
def tombstones(spark, path):
    edges = fx.edge_table(spark, path)
    return mutation.drop_tombstones(edges, edges.filter("etype = 3")).select("edge_id")


def _store(spark: SparkSession) -> GraphStore:
    schema = GraphSchema().add("edge", "weight", "float").add("edge", "low", "long", default=lambda s, d, t: F.least(s, d)).add("vertex", "title", "string")
    return GraphStore(spark, scratch_path(spark, "store"), schema).create()


_STORED = f"""{_E}, kept AS (SELECT * FROM E WHERE src <> 687 AND dst <> 687 AND edge_id <> (SELECT max(edge_id) FROM E WHERE src = 792 AND dst = 1001 AND src <> 687 AND dst <> 687))"""


@query("store_roundtrip", f"WITH {_STORED} SELECT src, dst, etype, edge_id, least(src, dst) AS low FROM kept")
def store_roundtrip(spark, path):
    """Ingest, delete a vertex and an edge, compact, and read back."""
    store = _store(spark)
    store.add_edges(fx.edge_table(spark, path), ["weight"])
    store.delete_vertex(687)
    store.delete_edge(792, 1001, None)
    store.compact()
    return _plain(store.edges().select("src", "dst", "etype", "edge_id", "low"))


@query("store_ingest", f"WITH {_E} SELECT src, dst, etype, edge_id, least(src, dst) AS low FROM E")
def store_ingest(spark, path):
    """Edges added to a stored graph, visible at once."""
    store = _store(spark)
    store.add_edges(fx.edge_table(spark, path), ["weight"])
    return _plain(store.edges().select("src", "dst", "etype", "edge_id", "low"))


@query("store_set_pointer", f"WITH {_E} SELECT edge_id, CASE WHEN etype = 2 THEN 0.5 ELSE weight END AS weight FROM E")
def store_set_pointer(spark, path):
    """An edge column of a stored graph set by pointers, twice; the later value stays, also behind a compaction."""
    store = _store(spark)
    edges = fx.edge_table(spark, path)
    store.add_edges(edges, ["weight"])
    for value in (0.125, 0.5):
        store.set_by_pointer(edges.filter("etype = 2").select("edge_id", F.lit(value).alias("value")), "weight")
    store.compact()
    return _plain(store.edges().select("edge_id", "weight"))


@query("store_set_vertex", f"WITH {_V} SELECT id, CASE WHEN vtype = 'movie' AND id % 2 = 0 THEN 'renamed' WHEN vtype = 'page' THEN 'again' ELSE title END AS title FROM V")
def store_set_vertex(spark, path):
    """Vertex values of a stored graph: set, and replaced by a second delivery."""
    store = _store(spark)
    vertices = fx.vertex_table(spark, path)
    store.add_vertices(vertices)
    store.set_vertex_values(vertices.filter("vtype = 'movie' and id % 2 = 0 or vtype = 'page'").select("id", F.lit("renamed").alias("value")), "title")
    store.add_vertices(vertices.filter("vtype = 'page'").withColumn("title", F.lit("again")))
    return store.vertices().select("id", "title")


def _edge_files(spark: SparkSession, path: str) -> str:
    source = scratch_path(spark, "stream")
    fx.edge_table(spark, path).repartition(6).write.parquet(source)
    return source


_STREAMED = "src bigint, dst bigint, etype tinyint, edge_id bigint, weight float"


@query("stream_replay", f"WITH {_E} SELECT src, dst, etype, edge_id FROM E")
def stream_replay(spark, path):
    """A stream whose last batch is replayed, as after a failure before its commit was noted: no edge comes twice."""
    source, checkpoint = _edge_files(spark, path), scratch_path(spark, "stream-checkpoint")
    store = _store(spark)
    for _ in range(2):
        ingest.ingest(ingest.edge_stream(spark, source, _STREAMED, 3), store, ["weight"], checkpoint).awaitTermination()
        noted = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/1")
        noted.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(noted, False)
    return _plain(store.edges().select("src", "dst", "etype", "edge_id"))


@query("stream_continuous", f"""
WITH {_E}, ends AS (SELECT src AS id, 0 AS i, 1 AS o FROM E UNION ALL SELECT dst, 1, 0 FROM E)
SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM ends GROUP BY id""")  # fmt: skip
def stream_continuous(spark, path):
    """Degrees recomputed behind each micro-batch; those of the last one."""
    made = []
    stream = ingest.edge_stream(spark, _edge_files(spark, path), _STREAMED, 3)
    after = lambda store, _: made.append(materialize(lookup.degrees(store.edges()), "degrees"))
    ingest.ingest(stream, _store(spark), ["weight"], scratch_path(spark, "stream-checkpoint"), after).awaitTermination()
    return made[-1].select("id", "in_degree", "out_degree")


@query("stream_ingest", f"WITH {_E} SELECT src, dst, etype, edge_id FROM E WHERE dst BETWEEN 1 AND 2000")
def stream_ingest(spark, path):
    """Edges streamed into a store in micro-batches, read back by range of dst."""
    store = _store(spark)
    stream = ingest.edge_stream(spark, _edge_files(spark, path), _STREAMED, 2)
    ingest.ingest(stream, store, ["weight"], scratch_path(spark, "stream-checkpoint")).awaitTermination()
    return _plain(store.edges((1, 2_000)).select("src", "dst", "etype", "edge_id"))


@query("stream_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark, path):
    """Events by hour and type, counted as a stream."""
    source = scratch_path(spark, "events")
    events = fx.table(spark, path, "events")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    name = "w" + source.rsplit("-", 1)[1]
    counted = ingest.run_to_memory(ingest.windowed_counts(stream, "ts", "10 minutes", "1 hour", "event_type"), name, "complete")
    return _plain(counted)


# --- sources and sinks -------------------------------------------------------


@query("load_edge_list", f"WITH {_E} SELECT src, dst, 0 AS etype FROM E")
def load_edge_list(spark, path):
    """Edges written as text and read back by the edge list reader."""
    target = scratch_path(spark, "edges")
    fx.edge_table(spark, path).select(F.concat_ws("\t", "src", "dst")).write.text(target)
    return _plain(loaders.read_edge_list(spark, target).select("src", "dst", "etype"))


@query("parallel_edges", f"WITH {_E} SELECT src, dst, count(*) - CAST(src = 792 AND dst = 1001 AS INT) AS n FROM E GROUP BY src, dst")
def parallel_edges(spark, path):
    """A list with parallel edges, loaded, one of them deleted: the others stay."""
    target = scratch_path(spark, "edges")
    fx.edge_table(spark, path).select(F.concat_ws("\t", "src", "dst")).write.text(target)
    loaded = materialize(loaders.read_edge_list(spark, target), "loaded")
    return mutation.delete_edge(loaded, 792, 1001, None).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("load_ratings", f"WITH {_R} SELECT src, dst, CAST(floor(rating) AS INT) AS rating FROM R")
def load_ratings(spark, path):
    """Ratings written as coordinate files and read back."""
    target = scratch_path(spark, "ratings")
    rows = fx.ratings(spark, path).select(F.concat_ws(" ", F.col("src") - loaders.USER_OFFSET, "dst", F.floor("rating")).alias("value"))

    def with_head(batches):
        import pyarrow as pa

        head = True
        for batch in batches:
            if head:
                yield pa.RecordBatch.from_arrays([pa.array(["%%MatrixMarket matrix", "% made here", "9 9 9"])], schema=batch.schema)
            head = False
            yield batch

    rows.mapInArrow(with_head, "value string").write.text(target)
    return _plain(loaders.read_matrix_market(spark, target).select("src", "dst", "rating"))


@query("load_titles", "SELECT id, CAST(coalesce(ns, 0) AS INT) AS year, coalesce(title, '') AS title FROM page_title")
def load_titles(spark, path):
    """Titles written as lines and read back."""
    target = scratch_path(spark, "titles")
    fx.table(spark, path, "page_title").select(F.concat_ws(",", "id", F.coalesce(F.col("ns").cast("string"), F.lit("NULL")), F.coalesce("title", F.lit("")))).write.option("encoding", "ISO-8859-1").text(target)
    return _plain(loaders.read_titles(spark, target))


def _dumped(spark: SparkSession, name: str, rows: DataFrame) -> str:
    """The folder of (a, b, title) rows written as insert statements of 100 tuples or so, with escaped quotes and an end of ``'s``."""
    target = scratch_path(spark, name)
    one = F.concat(F.lit("("), F.col("a"), F.lit(","), F.col("b"), F.lit(",'"), F.replace(F.col("title"), F.lit("'"), F.lit("\\'")), F.lit("\\'s',0)"))
    lines = rows.groupBy(F.pmod(F.xxhash64("a", "b", "title"), F.lit(997))).agg(F.array_join(F.collect_list(one), ",").alias("v"))
    lines.select(F.concat(F.lit(f"INSERT INTO `{name}` VALUES "), F.col("v"), F.lit(";"))).write.text(target)
    return target


def _page_dump(spark: SparkSession, path: str) -> DataFrame:
    pages = fx.table(spark, path, "page_title").select(F.col("id").alias("a"), F.coalesce("ns", F.lit(0)).alias("b"), F.coalesce("title", F.lit("")).alias("title"))
    return loaders.read_page_dump(spark, _dumped(spark, "page", pages))


@query("load_dump", "SELECT id, CAST(coalesce(ns, 0) AS INT) AS ns, coalesce(title, '') || '''s' AS title FROM page_title")
def load_dump(spark, path):
    """Pages written as insert statements and read back, with escaped quotes."""
    return _page_dump(spark, path)


@query("page_ingest", "SELECT id, coalesce(title, '') || '''s' AS title FROM page_title WHERE coalesce(ns, 0) = 0")
def page_ingest(spark, path):
    """Pages of namespace 0 of a dump."""
    return loaders.pages_of(_page_dump(spark, path))


@query("load_links", f"""
WITH {_E}, d AS (SELECT title, min(id) AS id FROM page_title GROUP BY title)
SELECT e.src, d.id AS dst FROM E e JOIN page_title p ON e.dst = p.id JOIN d ON d.title = p.title WHERE e.src <> d.id""")  # fmt: skip
def load_links(spark, path):
    """Links of a dump resolved by title; parallel links stay apart."""
    pages = fx.table(spark, path, "page_title")
    links = fx.edge_table(spark, path).join(pages.select(F.col("id").alias("dst"), "title"), "dst").filter("title is not null")
    read = loaders.read_link_dump(spark, _dumped(spark, "pagelinks", links.select(F.col("src").alias("a"), F.lit(0).alias("b"), "title")))
    return loaders.resolve_links(read, pages.withColumn("title", F.concat("title", F.lit("'s"))))[0].dropDuplicates(["edge_id"]).select("src", "dst")


# --- order -------------------------------------------------------------------


@query("quickselect", f"WITH {_E} SELECT edge_id AS value FROM E ORDER BY edge_id LIMIT 1 OFFSET 1000")
def quickselect(spark, path):
    return spark.createDataFrame([(sorting.quick_select(materialize(fx.edge_table(spark, path).select("edge_id"), "ids"), "edge_id", 1_000),)], "value bigint")


@query("rank_rows", f"WITH {_E} SELECT edge_id, row_number() OVER (ORDER BY src, edge_id) - 1 AS rank FROM E")
def rank_rows(spark, path):
    return sorting.rank_rows(fx.edge_table(spark, path).select("src", "edge_id"), "src", "edge_id").select("edge_id", "rank")


@query("sort_with_values", f"WITH {_E} SELECT src, dst, edge_id, weight FROM E ORDER BY src, dst, edge_id LIMIT 500")
def sort_with_values(spark, path):
    """The first rows of the edges sorted with their payload."""
    return _plain(sorting.sort_with_values(fx.edge_table(spark, path), "src", "dst", "edge_id").limit(500).select("src", "dst", "edge_id", "weight"))


@query("random_indices", "SELECT 100 AS n, 100 AS different, 100 AS known, TRUE AS same_again")
def random_indices(spark, path):
    """A sample without replacement: as many rows as wanted, all different, all of the table, and the same for a seed."""
    ids = fx.vertex_table(spark, path).select("id")
    one, two = sorting.sample_rows(ids, 100, 5), sorting.sample_rows(ids, 100, 5)
    known = one.join(ids.distinct(), "id", "left_semi").count()
    row = (one.count(), one.distinct().count(), known, one.exceptAll(two).isEmpty())
    return spark.createDataFrame([row], "n int, different int, known int, same_again boolean")


@query("random_vertex", "SELECT 10 AS n, 10 AS linked")
def random_vertex(spark, path):
    """Ten different vertices, all with edges."""
    edges = fx.edge_table(spark, path)
    drawn = materialize(lookup.random_vertex(edges, 3, 10), "drawn")
    linked = drawn.join(lookup.degrees(edges).filter("degree > 0"), "id", "left_semi").count()
    return spark.createDataFrame([(drawn.distinct().count(), linked)], "n int, linked int")


@query("argsort", """
WITH c AS (SELECT callback_id, any_value(s) AS s FROM (SELECT callback_id, list_sort(list_filter(neighbor_ids, lambda x: x IS NOT NULL), 'DESC') AS s FROM query_callback WHERE neighbor_ids IS NOT NULL) GROUP BY callback_id),
x AS (SELECT callback_id, unnest(s) AS v, generate_subscripts(s, 1) AS i FROM c)
SELECT callback_id, string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY v, i) AS positions FROM x GROUP BY callback_id""")  # fmt: skip
def argsort(spark, path):
    rows = fx.table(spark, path, "query_callback").filter("neighbor_ids is not null")
    s = F.sort_array(F.filter("neighbor_ids", lambda x: x.isNotNull()), asc=False)
    held = rows.select("callback_id", s.alias("s")).filter(F.size("s") > 0).dropDuplicates(["callback_id"])
    return held.select("callback_id", F.array_join(sorting.argsort(F.col("s")).cast("array<string>"), ",").alias("positions"))


@query("merge_sorted", f"WITH {_E} SELECT src, dst, edge_id FROM E WHERE etype IN (2, 3)")
def merge_sorted(spark, path):
    edges = fx.edge_table(spark, path).select("src", "dst", "edge_id", "etype")
    return sorting.merge_sorted(edges.filter("etype = 2"), edges.filter("etype = 3"), "src", "dst").drop("etype")


@query("top_edges", f"WITH {_E} SELECT edge_id, weight FROM E WHERE NOT isnan(weight) ORDER BY weight DESC, edge_id LIMIT 50")
def top_edges(spark, path):
    return _plain(sorting.top_n(fx.edge_table(spark, path).filter("not isnan(weight) and weight is not null").select("edge_id", "weight"), 50, F.desc("weight"), F.asc("edge_id")))


_ENDS = """d AS (SELECT title, min(id) AS id FROM page_title WHERE title IS NOT NULL GROUP BY title),
pick AS (SELECT min(id) AS a, max(id) AS b FROM d WHERE id IN (792, 1001))"""


@query("path_by_title", f"""
WITH RECURSIVE {_E}, {_ENDS},
L(id, level) USING KEY (id) AS (
  SELECT a, 0 FROM pick
  UNION SELECT e.dst, min(L.level) + 1 FROM L JOIN E e ON e.src = L.id LEFT JOIN recurring.L AS k ON k.id = e.dst WHERE k.id IS NULL AND L.level < 10 GROUP BY e.dst),
W(id, level) AS (
  SELECT id, level FROM L WHERE id = (SELECT b FROM pick)
  UNION ALL SELECT (SELECT min(x.id) FROM E e JOIN L x ON x.id = e.src AND x.level = W.level - 1 WHERE e.dst = W.id), W.level - 1 FROM W WHERE W.level > 0)
SELECT W.level AS step, W.id, d.title FROM W JOIN d ON d.id = W.id""")  # fmt: skip
def path_by_title(spark, path):
    """A shortest path between two titled pages."""
    pages = _titled(spark, path)
    names = [r["title"] for r in pages.filter(F.col("id").isin([792, 1001])).orderBy("id").collect()]
    return graph.path_by_title(fx.edge_table(spark, path), pages, "title", names[0], names[-1])


def _titled(spark: SparkSession, path: str) -> DataFrame:
    return fx.table(spark, path, "page_title").filter("title is not null").groupBy("title").agg(F.min("id").alias("id"))


@query("subgraph_by_titles", f"""
WITH {_E}, d AS (SELECT title, min(id) AS id FROM page_title WHERE title IS NOT NULL GROUP BY title), s AS (SELECT id FROM d WHERE id IN (792, 1001, 687, 274, 1879))
SELECT src, dst, etype, edge_id FROM E WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)""")  # fmt: skip
def subgraph_by_titles(spark, path):
    """The edges between five titled pages."""
    pages = _titled(spark, path)
    names = [r["title"] for r in pages.filter(F.col("id").isin([792, 1001, 687, 274, 1879])).collect()]
    return _plain(graph.subgraph_by_titles(fx.edge_table(spark, path), pages, "title", names).select("src", "dst", "etype", "edge_id"))
