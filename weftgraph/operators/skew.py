"""Equi-lookups and key statistics that stay balanced when one key holds much of the data."""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.session import tasks


@dataclass
class HotKeys:
    """Keys with more than ``limit`` rows: at most ``total / limit`` of them, so the list is bounded."""

    total: int = 0
    limit: int = 0
    counts: dict = field(default_factory=dict)
    rows: list = field(default_factory=list)

    def table(self, spark, key: str, kind: str) -> DataFrame:
        """(key, _splits): over how many salts each hot key is spread."""
        return spark.createDataFrame([(k, -(-n // self.limit)) for k, n in self.counts.items()], f"`{key}` {kind}, _splits int")


def hot_limit(spark, total: int, least: int, per_task: float = 0.25) -> int:
    """Rows above which a key is hot: ``per_task`` of an even share of a shuffle task, at least ``least``."""
    return max(least, int(total * per_task / tasks(spark)))


def hot_keys(df: DataFrame, key: str, aggs: list[Column] = (), least: int = 50_000, per_task: float = 0.25) -> HotKeys:
    """Count rows by ``key`` (combined map-side) and return those above the limit.

    The limit is that of ``hot_limit``. As no more than ``total / limit`` keys can exceed it, only
    that many rows reach the driver. ``aggs`` are computed beside the count.
    """
    most = int(tasks(df.sparkSession) / per_task) + 1
    seen = Observation()
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    top = (
        counted.observe(seen, F.sum("_n").alias("total"))
        .filter(F.col("_n") > least)
        .orderBy(F.desc("_n"))
        .limit(most)
        .collect()
    )
    try:
        total = seen.get.get("total") or 0
    except Py4JJavaError:  # the plan of an empty table has no place to observe
        total = 0
    limit = hot_limit(df.sparkSession, total, least, per_task)
    rows = [r for r in top if r["_n"] > limit]
    return HotKeys(total, limit, {r[key]: r["_n"] for r in rows}, rows)


def salted_lookup(
    facts: DataFrame, dim: DataFrame, key: str, hot: HotKeys | None, spread: list[str], how: str = "inner"
) -> DataFrame:
    """``facts`` joined with ``dim`` on ``key``; hot keys are spread over salts.

    A fact row of a hot key goes to the salt its ``spread`` columns hash to, and
    the dim rows of that key are copied to each salt: no task gets more than
    about ``hot.limit`` fact rows of one key, and dim grows by at most
    ``total / limit`` copies. Keys that are not hot have one salt.
    """
    if hot is None or not hot.counts:
        return facts.join(dim, key, how)
    table = F.broadcast(hot.table(facts.sparkSession, key, dict(facts.dtypes)[key]))
    salted = (
        facts.join(table, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_splits", F.lit(1))).cast("int"))
        .drop("_splits")
    )
    copied = (
        dim.join(table, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)))
        .drop("_splits")
    )
    return salted.join(copied, [key, "_salt"], how).drop("_salt")
