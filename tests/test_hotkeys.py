"""Hot keys: exact selection, skew-safe lookups and immediate repeats against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.hotkeys import exact_quantiles, immediate_repeats, ordered_buckets, quantile_rank, select_ranks
from weftgraph.operators.skew import hot_keys, salted_lookup

EDGES = "src bigint, dst bigint, etype tinyint, data_ptr bigint, ts timestamp_ntz, us string, _bucket int, p_ptr string"


def repeats(rows):
    by = defaultdict(dict)
    for src, dst, etype, ptr, ts in rows:
        if None not in (src, dst, etype, ptr, ts) and src >= 1 and dst >= 1 and etype != 15:
            by[src][ptr] = (ts, ptr, dst)
    out = set()
    for edges in by.values():
        line = sorted(edges.values())
        for a, b in zip(line, line[1:]):
            if a[2] == b[2] and (b[0] - a[0]).total_seconds() <= 60:
                out.add((min(a[1], b[1]), max(a[1], b[1])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    from datetime import datetime, timedelta

    r = random.Random(seed)
    start = datetime(2015, 1, 1)
    rows = []
    for ptr in range(3000):
        src = r.choice([7, 7, 7, 8, None, 0, -1, r.randrange(1, 40)])
        # many rows share one time, so a cut has to go on by pointer
        ts = r.choice([start, start + timedelta(seconds=r.randrange(40_000)), None, datetime(1970, 1, 1, 0, 0, r.randrange(59))])
        row = (src, r.choice([1, 2, 3, None]), r.choice([0, 6, 15, None, 1]), ptr * 977 % 3001, ts)
        rows += [row] * r.choice([1, 1, 1, 4])
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "x", 5, "y") for x in rows], EDGES)  # extra columns named like internal ones
    got = [tuple(x) for x in immediate_repeats(df, least=100).collect()]
    assert len(got) == len(set(got))
    assert set(got) == repeats(rows)


def test_repeats_of_nothing(spark):
    assert immediate_repeats(spark.createDataFrame([], EDGES)).collect() == []


def test_buckets_are_small_and_in_order(spark):
    rows = [(1, i % 5, i) for i in range(2000)] + [(2, i, i) for i in range(50)]
    cut, any_cut = ordered_buckets(spark.createDataFrame(rows, "k bigint, a bigint, b bigint"), "k", "a", "b", least=100)
    assert any_cut
    got = cut.filter("k = 1").orderBy("a", "b").select("_bucket").collect()
    buckets = [r[0] for r in got]
    assert buckets == sorted(buckets)
    assert max(buckets.count(b) for b in set(buckets)) <= 250


@pytest.mark.parametrize("values", [[5], [3] * 400, list(range(-200, 200)), [-(1 << 61), 0, 1 << 61] * 50])
def test_ranks(spark, values):
    df = spark.createDataFrame([("k", v) for v in values], "key string, v bigint")
    wanted = sorted({0, len(values) // 3, len(values) - 1})
    got = {x.rank: x for x in select_ranks(df, ["key"], "v", {("k",): (min(values), max(values))}, {("k",): wanted})}
    line = sorted(values)
    assert {r: got[r].value for r in wanted} == {r: line[r] for r in wanted}
    assert all(got[r].less == sum(v < line[r] for v in values) and got[r].equal == values.count(line[r]) for r in wanted)


def test_quantiles(spark):
    r = random.Random(3)
    rows = [(1, r.randrange(100)) for _ in range(999)] + [(2, 9), (3, None), (None, 4)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "k bigint, v bigint, n int")
    keyed = df.selectExpr("k as _key", "v as _v").filter("_key is not null and _v is not null")
    for hot in (None, hot_keys(keyed, "_key", [F.min("_v").alias("_lo"), F.max("_v").alias("_hi")], least=100)):
        got = {x.k: (x.n, x.q0, x.q1) for x in exact_quantiles(df, "k", "v", [0.5, 1.0], hot).collect()}
        line = sorted(v for k, v in rows if k == 1)
        assert got == {1: (999, line[quantile_rank(999, 0.5)], line[-1]), 2: (1, 9, 9)}


def test_salted_lookup(spark):
    facts = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 1), (3, 1), (None, 2)], "k bigint, x bigint")
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, name string")
    hot = hot_keys(facts, "k", least=50)
    assert set(hot.counts) == {1}
    for how in ("inner", "left"):
        plain = sorted(map(str, facts.join(dim, "k", how).select("k", "x", "name").collect()))
        assert sorted(map(str, salted_lookup(facts, dim, "k", hot, ["x"], how).select("k", "x", "name").collect())) == plain
