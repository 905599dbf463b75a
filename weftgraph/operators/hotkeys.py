"""Per-key ordered results where a few keys hold most rows.

Hot keys are cut into ranges of equal size by exact distributed selection:
histograms of the key's values are refined level by level until the bin of each
wanted rank holds one value. Only counts of bins travel; the values of a hot key
are never gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.edges import usable_edges
from weftgraph.operators.skew import HotKeys, hot_keys
from weftgraph.session import discard, materialize, micros

#: Keys of no more rows are never cut.
LEAST = 1_000
#: A histogram level has at most about 2 to this power bins, all open ranks together.
LEVEL_BINS = 22


@dataclass(frozen=True)
class Rank:
    """The value at ``rank`` (from 0) of ``key``: ``less`` values are smaller, ``equal`` are the same."""

    key: tuple
    rank: int
    value: int
    less: int
    equal: int


def select_ranks(df: DataFrame, keys: list[str], value: str, bounds: dict[tuple, tuple[int, int]], wanted: dict[tuple, list[int]]) -> list[Rank]:
    """Exact values at given ranks of given keys, by refining histograms.

    ``df`` has ``keys`` and a BIGINT ``value`` without nulls; ``bounds`` gives the
    least and greatest value of each wanted key, ``wanted`` the ranks. A level
    splits each active bin by its next 8 to 16 bits, the more the fewer bins are
    open, and counts the parts (counts merge map-side); the part that holds a rank becomes its next bin.
    A rank is resolved once its bin's least and greatest value are equal. Driver
    state is one row per wanted rank. Ties give the same value with its
    multiplicity; keys without rows are left out.
    """
    spark = df.sparkSession
    wanted = {k: sorted(set(r)) for k, r in wanted.items() if r and k in bounds}
    if not wanted:
        return []
    low = min(bounds[k][0] for k in wanted)
    width = max(max(bounds[k][1] for k in wanted) - low, 1).bit_length()
    kinds = dict(df.dtypes)
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    base = df.select(*keys, (F.col(value) - F.lit(low)).alias("_u"))
    base = base.join(F.broadcast(spark.createDataFrame([k for k in wanted], key_schema)), keys, "left_semi")
    done: list[Rank] = []
    # open ranks by key and bin; a bin is (shift, prefix), before the first level the whole range
    open_ranks: dict[tuple, list[tuple[int, int]]] = {(k, 0): [(r, 0) for r in ranks] for k, ranks in wanted.items()}
    shift = width
    while open_ranks:
        bits = max(8, min(16, LEVEL_BINS - len(open_ranks).bit_length()))
        upper, shift = shift, max(0, shift - bits)
        bins = spark.createDataFrame([(*k, p) for k, p in open_ranks], f"{key_schema}, _bin bigint")
        counted = (
            base.withColumn("_bin", F.shiftright("_u", upper) if upper < 64 else F.lit(0).cast("bigint"))
            .join(F.broadcast(bins), [*keys, "_bin"], "left_semi")
            .groupBy(*keys, "_bin", F.shiftright("_u", shift).alias("_part"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_u").alias("_lo"), F.max("_u").alias("_hi"))
        )
        order = Window.partitionBy(*keys, "_bin").orderBy("_part")
        placed = counted.withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
        ranks = spark.createDataFrame(
            [(*k, p, r, off) for (k, p), rs in open_ranks.items() for r, off in rs],
            f"{key_schema}, _bin bigint, _rank bigint, _off bigint",
        )
        inside = F.col("_rank") - F.col("_off") - F.col("_before")
        found = placed.join(F.broadcast(ranks), [*keys, "_bin"]).filter((inside >= 0) & (inside < F.col("_n"))).collect()
        open_ranks = {}
        for r in found:
            key = tuple(r[k] for k in keys)
            before = r["_off"] + r["_before"]
            if r["_lo"] == r["_hi"]:
                done.append(Rank(key, r["_rank"], r["_lo"] + low, before, r["_n"]))
            else:
                open_ranks.setdefault((key, r["_part"]), []).append((r["_rank"], before))
    return done


def quantile_rank(n: int, q: float) -> int:
    """Rank (from 0) of the discrete ``q`` quantile of ``n`` values: the first with at least ``q`` of them up to it."""
    return min(n - 1, max(0, -int(-(n * q) // 1) - 1))


def exact_quantiles(df: DataFrame, key: str, value: str, probs: list[float], hot: HotKeys | None = None) -> DataFrame:
    """(key, n, q0, q1, ...): exact discrete quantiles of ``value`` by ``key``.

    Keys below the hot limit are ranked within their group; hot keys go through
    ``select_ranks``. Null keys form a group of their own only if they are not
    hot; rows with a null value are left out, so a key without values has no row.
    Equal values count by their multiplicity. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_key"), F.col(value).cast("bigint").alias("_v")).filter("_v is not null and _key is not null")
    kind = dict(rows.dtypes)["_key"]
    hot = hot or hot_keys(rows, "_key", [F.min("_v").alias("_lo"), F.max("_v").alias("_hi")], LEAST)
    names = [f"q{i}" for i in range(len(probs))]
    cold = rows
    if hot.rows:
        cold = rows.join(F.broadcast(hot.table(spark, "_key", kind)), "_key", "left_anti")
    group = Window.partitionBy("_key")
    ranked = cold.withColumn("_r", F.row_number().over(group.orderBy("_v")) - 1).withColumn("_n", F.count(F.lit(1)).over(group))
    at = [F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.ceil(F.col("_n") * F.lit(float(q))) - 1)) for q in probs]
    out = ranked.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("_r") == a, F.col("_v"))).alias(c) for a, c in zip(at, names)]
    )
    if hot.rows:
        bounds = {(r["_key"],): (r["_lo"], r["_hi"]) for r in hot.rows}
        count = {(r["_key"],): r["_n"] for r in hot.rows}
        want = {k: [quantile_rank(n, q) for q in probs] for k, n in count.items()}
        held = materialize(rows.join(F.broadcast(hot.table(spark, "_key", kind)), "_key", "left_semi"), "hot_values")
        got = {(x.key, x.rank): x.value for x in select_ranks(held, ["_key"], "_v", bounds, want)}
        discard(held)
        exact = [(k[0], n, *[got[(k, quantile_rank(n, q))] for q in probs]) for k, n in count.items()]
        schema = f"_key {kind}, n bigint, " + ", ".join(f"{c} bigint" for c in names)
        out = out.unionByName(spark.createDataFrame(exact, schema))
    return out.withColumnRenamed("_key", key)


def _bucket_of(splits: str, most: int, value):
    """How many entries of the sorted array column ``splits`` are at most ``value``: a binary search inside the row."""
    steps = [1 << i for i in range(max(most, 1).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(F.col(splits), at + step - 1) <= value, at + step).otherwise(at),
    )


def ordered_buckets(df: DataFrame, key: str, first: str, second: str, least: int = LEAST) -> tuple[DataFrame, bool]:
    """``df`` with ``_bucket``: equal key ranges in the order (``first``, ``second``), each of bounded size.

    Keys below the limit keep one bucket: -1 if any key is cut, else 0. The hot keys' values
    are written once, for all levels of the selection. A hot key is cut at exact ranks, one per
    ``limit`` rows; where more than ``limit`` rows share one ``first`` value, the
    cut goes on within it by ``second``. Buckets of a key increase with the order.
    Also tells whether any key was cut. Both columns are BIGINT without nulls.
    """
    spark = df.sparkSession
    hot = hot_keys(df, key, [F.min(first).alias("_lo"), F.max(first).alias("_hi")], least)
    if not hot.rows:
        return df.withColumn("_bucket", F.lit(0)), False
    bounds = {(r[key],): (r["_lo"], r["_hi"]) for r in hot.rows}
    wanted = {(r[key],): list(range(hot.limit, r["_n"], hot.limit)) for r in hot.rows}
    cuts: dict[tuple, set[tuple[int, int]]] = {}
    heavy: dict[tuple, list[int]] = {}
    least_id = -(1 << 63)
    held = df.join(F.broadcast(hot.table(spark, key, dict(df.dtypes)[key])), key, "left_semi").select(key, first, second)
    held = materialize(held, "hot_values")
    for x in select_ranks(held, [key], first, bounds, wanted):
        cuts.setdefault(x.key, set()).add((x.value, least_id))
        if x.equal > hot.limit:
            heavy.setdefault((*x.key, x.value), []).append(x.rank - x.less)
    if heavy:
        kinds = dict(df.dtypes)
        table = spark.createDataFrame(list(heavy), f"`{key}` {kinds[key]}, `{first}` {kinds[first]}")
        tied = held.join(F.broadcast(table), [key, first], "left_semi")
        ends = tied.groupBy(key, first).agg(F.min(second).alias("_lo"), F.max(second).alias("_hi")).collect()
        tie_bounds = {(r[key], r[first]): (r["_lo"], r["_hi"]) for r in ends}
        for x in select_ranks(tied, [key, first], second, tie_bounds, heavy):
            cuts[(x.key[0],)].add((x.key[1], x.value))
    discard(held)
    most = max(map(len, cuts.values()))
    table = spark.createDataFrame(
        [(k[0], sorted(c)) for k, c in cuts.items()],
        f"`{key}` {dict(df.dtypes)[key]}, _cuts array<struct<a:bigint,b:bigint>>",
    )
    here = F.struct(F.col(first).cast("bigint").alias("a"), F.col(second).cast("bigint").alias("b"))
    cut = df.join(F.broadcast(table), key, "left")
    return cut.withColumn("_bucket", F.when(F.col("_cuts").isNull(), -1).otherwise(_bucket_of("_cuts", most, here))).drop("_cuts"), True


def immediate_repeats(edges: DataFrame, within_seconds: int = 60, least: int = LEAST) -> DataFrame:
    """(data_ptr_1, data_ptr_2): neighbours in a src's time order with the same dst and close times.

    Usable edges with a non-null ``ts`` are ordered by (ts, data_ptr) within each
    ``src``; repeated deliveries of one ``data_ptr`` count once. Hot sources are
    cut by ``ordered_buckets``; each bucket is sorted on its own and the borders
    between buckets are compared through one row per bucket. Ties in ``ts`` are
    ordered by ``data_ptr``. Rows with a null in src, dst, etype, ts or data_ptr
    take no part; an empty table gives no rows; other columns are ignored.
    """
    rows = usable_edges(edges).filter("ts is not null and data_ptr is not null")
    rows = rows.select("src", "dst", "data_ptr", micros(rows, "ts").alias("us"))
    cut, any_cut = ordered_buckets(rows, "src", "us", "data_ptr", least)
    order = Window.partitionBy("src", "_bucket").orderBy("us", "data_ptr")
    once = cut.withColumn("_same", F.lag("data_ptr").over(order) == F.col("data_ptr"))
    once = once.filter(~F.coalesce("_same", F.lit(False)))
    prev = once.select(
        "src", "_bucket", "data_ptr", "dst", "us",
        F.lag("data_ptr").over(order).alias("p_ptr"), F.lag("dst").over(order).alias("p_dst"), F.lag("us").over(order).alias("p_us"),
        F.lead("us").over(order).isNull().alias("tail"),
    )
    near = (F.col("p_dst") == F.col("dst")) & (F.col("us") - F.col("p_us") <= within_seconds * 1_000_000)
    if any_cut:
        # one pass writes the pairs inside buckets and the two ends of each bucket; then the ends are compared
        at_end = (F.col("_bucket") >= 0) & (F.col("p_ptr").isNull() | F.col("tail"))
        kept = materialize(prev.filter(near | at_end), "repeats")
        ends = kept.filter(at_end)
        line = Window.partitionBy("src").orderBy("us", "data_ptr")
        borders = ends.select(
            "src", "_bucket", "data_ptr", "dst", "us", F.col("p_ptr").alias("in_ptr"),
            F.lag("data_ptr").over(line).alias("p_ptr"), F.lag("dst").over(line).alias("p_dst"), F.lag("us").over(line).alias("p_us"),
        ).filter("in_ptr is null")
        same = ["data_ptr", "dst", "us", "p_ptr", "p_dst", "p_us"]
        prev = kept.filter("p_ptr is not null").select(*same).unionByName(borders.select(*same))
    return prev.filter(near).select(
        F.least("p_ptr", "data_ptr").alias("data_ptr_1"), F.greatest("p_ptr", "data_ptr").alias("data_ptr_2")
    )
