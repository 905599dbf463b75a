"""Groups, frequent values, similar sets and top-N against brute force, with dirt and hot keys."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weftgraph.llm.components import group_links
from weftgraph.llm.heavy import frequent_above, top_k_frequent
from weftgraph.llm.setjoin import merge_lists, similar_pairs, similarity_links
from weftgraph.llm.topn import top_n_per_group


def groups(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in list(up))


@pytest.mark.parametrize("shape", ["chain", "star", "mixed", "loops", "empty"])
def test_group_links(spark, shape):
    r = random.Random(5)
    pairs = {
        "chain": [(i, i + 1) for i in range(1, 120)],
        "star": [(1000, i) for i in range(1, 400)],
        "mixed": [(r.randrange(1, 300), r.randrange(1, 300)) for _ in range(150)] * 2 + [(None, 3), (4, None)],
        "loops": [(5, 5), (7, 7), (7, 8)],
        "empty": [],
    }[shape]
    df = spark.createDataFrame([(*p, 1, "x") for p in pairs], "src bigint, dst bigint, c int, v string")
    got = sorted(tuple(x) for x in group_links(df, least=100).collect())
    assert got == groups([p for p in pairs if None not in p])


@pytest.mark.parametrize("nodes", [1, 5])
def test_top_k(spark, nodes):
    r = random.Random(6)
    rows = [(int(r.paretovariate(0.7)) % 500, i) for i in range(4000)]
    sent = rows + rows[:900] * 3 + [(None, 9001), (3, None)]
    df = spark.createDataFrame([(*x, 2) for x in sent], "dst bigint, ptr bigint, n int")
    counts = Counter(d for d, _ in rows)
    for k in (1, 10, 10_000):
        top, total = top_k_frequent(df, "dst", "ptr", k, nodes)
        assert total == len(rows)
        assert [tuple(x) for x in top.collect()] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    assert {x.dst for x in frequent_above(df, "dst", "ptr", 0.02).collect()} == {d for d, n in counts.items() if n >= 0.02 * len(rows)}
    assert top_k_frequent(df.limit(0), "dst", "ptr", 5, nodes)[0].collect() == []


@pytest.mark.parametrize("n", [1, 3])
def test_top_n(spark, n):
    r = random.Random(7)
    rows = []
    for item in range(3000):
        group = r.choice([1, 1, 2, None, r.randrange(-5, 300)])
        score = r.choice([0.5, float("nan"), None, round(r.random(), 1), -2.0, float("inf")])
        rows += [(group, score, r.choice([1, 2, None]), item)] * r.choice([1, 1, 5])
    df = spark.createDataFrame([(*x, 0, 0) for x in rows], "src bigint, weight float, dst bigint, data_ptr bigint, bucket int, g int")
    best = defaultdict(set)
    for g, s, t, i in rows:
        if None not in (g, s, t) and s == s:
            best[g].add((-s, t, i))
    expected = sorted((g, i) for g, x in best.items() for _, _, i in sorted(x)[:n])
    assert sorted(tuple(x) for x in top_n_per_group(df, "src", "weight", "dst", "data_ptr", n, least=100).collect()) == expected
    assert top_n_per_group(df.limit(0), "src", "weight", "dst", "data_ptr", n).collect() == []


def test_runs_are_whole_and_sought(spark, monkeypatch):
    """A group of very many rows lies whole in its runs; of its row groups those behind the first N items are not read."""
    from pyarrow import fs

    from weftgraph.llm import topn

    monkeypatch.setattr(topn, "ROW_GROUP", 1 << 14)
    rows = spark.range(60_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-5).alias("g"), (-F.col("id") % 997).cast("double").alias("down"), F.lit(1).cast("bigint").alias("tie"), F.col("id").alias("item"))
    path, buckets = topn.store_runs(rows, least=1_000_000)
    assert spark.read.parquet(path).count() == 60_000 and buckets == 1
    local = path.removeprefix("file:")
    where = fs.LocalFileSystem().get_file_info(fs.FileSelector(local, recursive=True))
    runs = [topn.Run(fs.LocalFileSystem(), f.path) for f in where if f.path.endswith(".parquet")]
    groups = sum(r.file.num_row_groups for r in runs)
    got = list(topn.merge_top(runs, 2))
    assert len(got) == 6_002 and got == sorted(got, key=lambda x: x[0])
    assert sum(r.skipped for r in runs) > groups / 2


def test_merge_lists():
    r = random.Random(8)
    for _ in range(300):
        lists = [sorted(r.sample(range(60), r.randrange(0, 40))) for _ in range(r.randrange(1, 12))]
        need, low, high = r.randrange(1, 8), r.randrange(0, 30), r.randrange(20, 61)
        count = Counter(x for one in lists for x in one if low <= x < high)
        assert merge_lists([list(x) for x in lists], need, low, high) == sorted(x for x, n in count.items() if n >= need)


@pytest.mark.parametrize("threshold, block", [(0.6, 2000), (0.6, 7), (0.8, 7)])
def test_similar_pairs(spark, threshold, block):
    r = random.Random(9)
    rows = []
    for i in range(400):
        base = r.choice([list(range(1, 9)), list(range(50, 60)), [r.randrange(1, 60) for _ in range(r.randrange(0, 20))]])
        values = [x for x in base if r.random() > 0.15] + r.choice([[], [None, 0, -1], [base[0] if base else 1]])
        r.shuffle(values)
        rows.append((i, values))
        if i % 7 == 0:
            rows.append((i, values[::-1]))
    rows += [(900, None), (901, []), (None, [1, 2, 3, 4]), (902, [0, -1, None, 5, 6, 7])]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "callback_id bigint, neighbor_ids array<bigint>, rep string, s int")
    sets = {i: {x for x in v if x and x >= 1} for i, v in rows if i is not None and v}
    sets = {i: s for i, s in sets.items() if len(s) >= 4}
    t = Fraction(str(threshold))
    expected = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]))
    assert sorted(tuple(x) for x in similar_pairs(df, "callback_id", "neighbor_ids", threshold, block=block).collect()) == expected
    if block == 2000:
        degree = Counter(x for p in expected for x in p)
        links = similarity_links(df, "callback_id", "neighbor_ids", threshold).collect()
        assert {x.id: x.links for x in links} == {i: degree[i] for i in sets}
        assert similar_pairs(df.limit(0), "callback_id", "neighbor_ids", threshold).collect() == []
