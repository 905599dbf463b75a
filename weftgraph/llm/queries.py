"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.components import group_links
from weftgraph.llm.heavy import frequent_above, top_k_frequent
from weftgraph.llm.leaks import leaked_items
from weftgraph.llm.sentences import sentences
from weftgraph.llm.setjoin import similar_pairs, similarity_links
from weftgraph.llm.tokenize import encode_corpus
from weftgraph.llm.topn import top_n_per_group
from weftgraph.operators.edges import usable_edges

Query = Callable[[SparkSession, str], DataFrame]

#: The edge type of a match result.
MATCH = 6


def _edges(spark: SparkSession, path: str) -> DataFrame:
    return usable_edges(spark.read.parquet(f"{path}/result_edge.parquet"))


def p1_found(spark: SparkSession, path: str) -> DataFrame:
    """Every matched id with the least id of its group."""
    return group_links(_edges(spark, path).filter(F.col("etype") == MATCH))


def p3_found(spark: SparkSession, path: str) -> DataFrame:
    """Each dst that holds at least 0.5% of all usable edges."""
    return frequent_above(_edges(spark, path), "dst", "data_ptr", 0.005).select("dst")


def p3_top(spark: SparkSession, path: str) -> DataFrame:
    """The 100 dst with the most usable edges, with their counts."""
    return top_k_frequent(_edges(spark, path), "dst", "data_ptr", 100)[0]


def p4_found(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of callbacks whose neighbour sets have a Jaccard similarity of 0.6 or more."""
    pairs = similar_pairs(spark.read.parquet(f"{path}/query_callback.parquet"), "callback_id", "neighbor_ids", 0.6)
    return pairs.select(F.col("id_1").alias("callback_id_1"), F.col("id_2").alias("callback_id_2"))


def p4_links(spark: SparkSession, path: str) -> DataFrame:
    """Each callback with the class of its set and its number of similar callbacks."""
    links = similarity_links(spark.read.parquet(f"{path}/query_callback.parquet"), "callback_id", "neighbor_ids", 0.6)
    return links.select(F.col("id").alias("callback_id"), F.col("rep").alias("class_id"), "links")


def p5_found(spark: SparkSession, path: str) -> DataFrame:
    """The three strongest usable edges of each src."""
    return top_n_per_group(_edges(spark, path), "src", "weight", "dst", "data_ptr", 3)


def p6_ids(spark: SparkSession, path: str) -> DataFrame:
    """The token ids of each document."""
    return encode_corpus(spark.read.parquet(f"{path}/documents.parquet"))


def _leaks(spark: SparkSession, path: str, exact: int) -> DataFrame:
    found = leaked_items(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/eval_item.parquet"))
    return found.filter(F.col("exact") == exact).select("doc_id", "item_id")


def p7_found(spark: SparkSession, path: str) -> DataFrame:
    """Documents with a passage of an evaluation item."""
    return _leaks(spark, path, 1)


def p7_templates(spark: SparkSession, path: str) -> DataFrame:
    """Documents with a re-parameterised copy of an item's passage and no verbatim one."""
    return _leaks(spark, path, 0)


def p8_found(spark: SparkSession, path: str) -> DataFrame:
    """The end of each sentence unit of each document."""
    return sentences(spark.read.parquet(f"{path}/documents.parquet"))


def queries() -> dict[str, Query]:
    every = [p1_found, p3_found, p3_top, p4_found, p4_links, p5_found, p6_ids, p7_found, p7_templates, p8_found]
    return {q.__name__: q for q in every}


_USABLE = "src >= 1 AND dst >= 1 AND etype IS NOT NULL AND etype <> 15"
_SETS = """sets AS (
  SELECT callback_id, any_value(s) AS s FROM (
    SELECT callback_id, list_sort(list_distinct(list_filter(neighbor_ids, lambda x: x >= 1))) AS s FROM query_callback
    WHERE callback_id IS NOT NULL) WHERE len(s) >= 4 GROUP BY callback_id),
items AS (SELECT callback_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.callback_id AS c1, b.callback_id AS c2, a.n + b.n AS n, count(*) AS common
  FROM items a JOIN items b ON a.x = b.x AND a.callback_id < b.callback_id GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
WITH RECURSIVE links AS (SELECT DISTINCT src AS a, dst AS b FROM result_edge WHERE {_USABLE} AND etype = {MATCH}),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
label(v, g) USING KEY (v) AS (
  SELECT a AS v, min(least(a, b)) AS g FROM both_ways GROUP BY a
  UNION
  SELECT e.b AS v, min(l.g) AS g FROM label l JOIN both_ways e ON e.a = l.v JOIN recurring.label k ON k.v = e.b
  WHERE l.g < k.g GROUP BY e.b)
SELECT v AS id, g AS group_id FROM label""",
        "p3_found": f"""
WITH e AS (SELECT DISTINCT data_ptr, dst FROM result_edge WHERE {_USABLE})
SELECT dst FROM e GROUP BY dst HAVING count(*) >= 0.005 * (SELECT count(*) FROM e)""",
        "p3_top": f"""
WITH e AS (SELECT DISTINCT data_ptr, dst FROM result_edge WHERE {_USABLE})
SELECT dst, count(*) AS n FROM e GROUP BY dst ORDER BY n DESC, dst LIMIT 100""",
        "p4_found": f"""
WITH {_SETS}
SELECT c1 AS callback_id_1, c2 AS callback_id_2 FROM pairs WHERE common * 10 >= 6 * (n - common)""",
        "p4_links": f"""
WITH {_SETS}, ok AS (SELECT c1, c2 FROM pairs WHERE common * 10 >= 6 * (n - common)),
ends AS (SELECT c1 AS c FROM ok UNION ALL SELECT c2 FROM ok),
degree AS (SELECT c, count(*) AS links FROM ends GROUP BY c)
SELECT callback_id, min(callback_id) OVER (PARTITION BY s) AS class_id, coalesce(links, 0) AS links
FROM sets LEFT JOIN degree ON c = callback_id""",
        "p5_found": f"""
WITH e AS (SELECT DISTINCT src, dst, data_ptr, weight FROM result_edge WHERE {_USABLE} AND weight IS NOT NULL AND NOT isnan(weight))
SELECT src, data_ptr FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, data_ptr) <= 3""",
    }
