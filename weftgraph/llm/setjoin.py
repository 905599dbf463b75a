"""All pairs of similar sets by T-occurrence list merging.

Equal sets become one class first. The classes are entered into the lists of the
tokens of their prefix, rarest first: two similar sets share one of those. An entry
holds no set, only its size, its place in the list and a signature; a list of more
than ``BLOCK`` entries is split by the next token that two similar sets must share,
and if that does not do, into blocks. Entries whose size, place and signature fit
none of their list are left out, and the sets of the others are brought to
their list. There inverted lists over the sets, ordered by set size, are merged for
each probe set: a similar set must occur in at least T of the lists of its tokens. The
longest lists are set aside for binary search; the others go through a heap that,
whenever the front set occurs too rarely to reach T, pops what it can and skips each
popped list by binary search to the next front.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.skew import HotKeys, hot_keys, salted_lookup
from weftgraph.session import discard, materialize, ship_package

#: Sets of one list that are merged in one task; longer ones are split. It does not depend on the data.
BLOCK = 2_000
#: At most this many tokens keep their exact frequency for the order; the rest are rarer. The order only decides how long lists are.
RANKED_TOKENS = 200_000


def need_overlap(a: int, b: int, t: Fraction) -> int:
    """Common elements that sets of ``a`` and ``b`` elements need for a Jaccard similarity of ``t``."""
    num, den = t.numerator, t.denominator
    return -(-num * (a + b) // (den + num))


def merge_lists(lists: list[list[int]], need: int, start: int, end: int) -> list[int]:
    """Ids in [start, end) that occur in at least ``need`` of the sorted lists of different ids.

    Divide and skip: the longest lists, fewer than ``need``, are only searched;
    the rest are merged over a heap with skipping.
    """
    if len(lists) < need:
        return []
    lists = [x for x in lists if x and x[-1] >= start and x[0] < end]
    if len(lists) < need or need < 1:
        return []
    lists.sort(key=len)
    # the longer the longest list, the fewer are worth searching for every front
    aside = min(need - 1, int(need / (0.01 * math.log(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    least = need - aside
    heap = []
    for i, x in enumerate(short):
        at = bisect_left(x, start)
        if at < len(x):
            heap.append((x[at], i, at))
    heapq.heapify(heap)
    found = []
    while len(heap) >= least:
        front = heap[0][0]
        if front >= end:
            break
        popped = []
        while heap and heap[0][0] == front:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            count = len(popped)
            for k, x in enumerate(reversed(long)):
                if count >= need or count + len(long) - k < need:
                    break
                at = bisect_left(x, front)
                count += at < len(x) and x[at] == front
            if count >= need:
                found.append(front)
            target = front + 1
        else:
            # the next least - 1 fronts cannot make a result before the one that stays
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = heap[0][0]
        for _, i, at in popped:
            x = short[i]
            at = bisect_left(x, target, at)
            if at < len(x):
                heapq.heappush(heap, (x[at], i, at))
    return found


def join_block(first: tuple[int, ...], index: list[tuple[int, int, int, list[int]]], probe: list[tuple[int, int, int, list[int]]] | None, t: Fraction) -> Iterator[tuple[int, int, int]]:
    """(class, class, common) of similar sets between ``index`` and ``probe`` (None: within ``index``).

    Sets come with their size, the place of ``first[0]`` and their tokens, rarest first. A pair
    is given only in the list of its first common tokens, so what stands before them
    in a set is no part of the lists, and they themselves are no part either.
    """
    num, den = t.numerator, t.denominator
    index = sorted(index, key=lambda x: (x[1], x[0]))
    sizes = [x[1] for x in index]
    within = probe is None
    held = len(first)
    lists: dict[int, list[int]] = {}
    for i, (_, _, at, tokens) in enumerate(index):
        for x in tokens[at:]:
            if x in first:
                continue
            if x in lists:
                lists[x].append(i)
            else:
                lists[x] = [i]
    sets: dict[int, set[int]] = {}
    for j, (name, size, at, tokens) in enumerate(index if within else probe):
        low = bisect_left(sizes, -(-num * size // den))
        high = j if within else bisect_left(sizes, size * den // num + 1)
        if low >= high:
            continue
        need = need_overlap(size, sizes[low], t) - held
        near = range(low, high) if need < 1 else merge_lists([lists[x] for x in tokens[at:] if x in lists], need, low, high)
        for i in near:
            if i not in sets:
                sets[i] = set(index[i][3])
            common = [x for x in tokens if x in sets[i]]
            if len(common) >= need_overlap(size, sizes[i], t) and tuple(common[:held]) == first:
                a, b = index[i][0], name
                yield min(a, b), max(a, b), len(common)


def as_sets(df: DataFrame, record: str, values: str, least_size: int, least_value: int) -> DataFrame:
    """(id, s, k1, k2): each delivery's sorted set of values, without nulls and values below ``least_value``, and two fingerprints.

    Sets smaller than ``least_size``, empty sets and null arrays are left out.
    """
    kept = F.filter(F.col(values), lambda x: x.isNotNull() & (x >= least_value))
    rows = df.select(F.col(record).cast("bigint").alias("id"), F.array_sort(F.array_distinct(kept)).alias("s"))
    rows = rows.filter((F.size("s") >= max(1, least_size)) & F.col("id").isNotNull())
    return rows.select("id", "s", F.xxhash64(F.lit(1), "s").alias("k1"), F.xxhash64(F.lit(2), F.size("s"), "s").alias("k2"))


def classes_of(sets: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """((id, rep) of every record, (rep, s) of every different set, the tables that the latter reads); rep is the least id with that set.

    Sets are compared by two 64-bit fingerprints; the least id is combined
    map-side, so a set that a third of all records hold makes no hot task. A record that
    was delivered with different sets has the one of the least fingerprints.
    """
    named = materialize(sets, "sets")
    chosen = named.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("id", "k.k1", "k.k2")
    chosen = materialize(chosen, "chosen")
    reps = chosen.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    tagged = salted_lookup(chosen, reps.withColumnRenamed("k2", "_k2"), "k1", hot_keys(chosen.select("k1"), "k1"), ["id"])
    members = materialize(tagged.filter("k2 = _k2").select("id", "rep"), "members")
    classes = named.groupBy("k1", "k2").agg(F.first("s").alias("s")).join(reps, ["k1", "k2"]).select("rep", "s")
    return members, classes, [named, chosen]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token."""
    h = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def ordered_sets(classes: DataFrame, t: Fraction, block: int) -> tuple[DataFrame, DataFrame | None]:
    """(rep, s, n, prefix, low, high): tokens in global order, rarest first, how many make the prefix, and a 128-bit signature;
    and the tokens (token) that more than ``block`` sets hold, None if they are not all known.

    The exact frequencies of at most ``RANKED_TOKENS`` tokens are broadcast: the
    most frequent ones, found by a limit on the count that so many cannot exceed.
    All other tokens are rarer; they come first, by hash. A map: no set is shuffled.
    """
    spark = classes.sparkSession
    tokens = classes.select(F.explode("s").alias("x"))
    total = classes.agg(F.sum(F.size("s"))).first()[0] or 0
    floor = max(2, total // RANKED_TOKENS)
    ranked = tokens.groupBy("x").agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") > floor).toArrow().sort_by("x")
    shipped = spark.sparkContext.broadcast((ranked.column("x").to_numpy(), ranked.column("f").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shipped.value
        for batch in batches:
            column = batch.column(1)
            starts = column.offsets.to_numpy()
            flat = column.values.to_numpy()[starts[0] : starts[-1]]
            starts = starts - starts[0]
            sizes = np.diff(starts).astype(np.int64)
            h = mixed(flat)
            f = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                f = np.where(known[at] == flat, counts[at], 0)
            order = np.lexsort((flat, h, f, np.repeat(np.arange(len(sizes)), sizes)))
            bit = h >> np.uint64(57)
            one = np.uint64(1) << (bit & np.uint64(63))
            signs = [np.bitwise_or.reduceat(np.where(bit < 64, one, np.uint64(0)) if lower else np.where(bit < 64, np.uint64(0), one), starts[:-1]) if len(sizes) else np.empty(0, np.uint64) for lower in (True, False)]
            prefix = sizes - -(-sizes * t.numerator // t.denominator) + 1
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat[order], pa.int64())), pa.array(sizes.astype(np.int32)), pa.array(prefix.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in signs)]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "s", "n", "prefix", "low", "high"])

    ship_package(spark)
    ordered = classes.mapInArrow(run, "rep bigint, s array<bigint>, n int, prefix int, low bigint, high bigint")
    frequent = ranked.filter(pc.field("f") > block).column("x").to_pylist()
    return ordered, spark.createDataFrame([(x,) for x in frequent], "token bigint") if floor <= block else None


def list_entries(ordered: DataFrame, frequent: DataFrame | None, t: Fraction, block: int) -> DataFrame:
    """(token, second, i, j, own, rep, n, at, last, low, high): the lists' entries, each list of at most about ``block``.

    ``at`` is the place of ``token`` in the set, ``last`` that of ``second``, which in
    lists that were not split is ``token`` itself. A list is split by the second common
    token: if two sets need two common tokens at least, they share a second one within
    one more token than their prefixes. What is still too long is cut into blocks, of which a set
    joins its own with every other.
    """
    held = ["rep", "n", "low", "high"]
    entries = ordered.select(*held, F.posexplode(F.slice("s", F.lit(1), F.col("prefix"))).alias("at", "token"))
    listed = entries.select("token") if frequent is None else entries.select("token").join(frequent, "token", "left_semi")
    long = listed.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block)
    if frequent is None or not frequent.isEmpty():
        long = materialize(long, "long_lists")
    flat = entries.withColumn("second", F.col("token")).withColumn("last", F.col("at"))
    rest = None
    if (frequent is None or not frequent.isEmpty()) and not long.isEmpty():
        flat = flat.join(long, "token", "left_anti")
        rest = ordered.select(*held, "prefix", "s", F.posexplode(F.slice("s", F.lit(1), F.col("prefix"))).alias("at", "token")).join(long, "token")
        # sets that need but one common token cannot be split by a second one
        one, more = (F.col("n") * t.numerator <= t.denominator), (F.col("n") * t.numerator > t.denominator)
        if rest.filter(one).isEmpty():
            second = F.posexplode(F.slice("s", F.col("at") + 2, F.col("prefix") - F.col("at"))).alias("gap", "second")
            rest = rest.filter(more).select(*held, "at", "token", second).withColumn("last", F.col("at") + 1 + F.col("gap")).drop("gap")
            sizes = materialize(rest.groupBy("token", "second").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block), "long_lists")
            rest = rest.join(sizes, ["token", "second"], "left")
        else:
            rest = rest.withColumn("second", F.col("token")).withColumn("last", F.col("at")).drop("prefix", "s")
        # blocks of a list that is still long: a set joins its own block with every block, once each
        rest = rest.withColumn("blocks", F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int"))
        rest = rest.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rest = rest.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    names = ["token", "second", "i", "j", "own", "rep", "n", "at", "last", "low", "high"]
    flat = flat.withColumns({c: F.lit(0) for c in ("i", "j", "own")}).select(names)
    return flat if rest is None else flat.unionByName(rest.select(names))


def with_partners(entries: DataFrame, t: Fraction) -> DataFrame:
    """The entries that some other one of their list fits by size, place and signature; pairs are not formed.

    Two sets have at most as many common tokens as follow their first common one in
    either, and at most half of what their sizes leave beyond the bits in which their
    signatures differ.
    """
    num, den = t.numerator, t.denominator
    other = entries.select(*[F.col(c).alias(f"_{c}") for c in entries.columns])

    def of(c: str) -> tuple[Column, Column]:
        return F.col(c), F.col(f"_{c}")

    (n, m), (p, q) = of("n"), of("last")
    differ = sum(F.bit_count(x.bitwiseXOR(y)) for x, y in (of("low"), of("high")))
    both = (n + m).cast("bigint")
    led = F.when(F.col("token") == F.col("second"), 0).otherwise(1)
    fits = (F.least(n, m) * den >= F.greatest(n, m) * num) & ((led + F.least(n - p, m - q)) * (den + num) >= both * num) & ((both - differ) * (den + num) >= both * (2 * num))
    apart = (F.col("rep") != F.col("_rep")) & ((F.col("i") == F.col("j")) | (F.col("own") != F.col("_own")))
    same = [F.col(c) == F.col(f"_{c}") for c in ("token", "second", "i", "j")]
    return entries.join(other, [*same, fits & apart], "left_semi")


def similar_classes(classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(rep_1, rep_2, common): pairs of different sets with a Jaccard similarity of at least ``threshold``."""
    spark = classes.sparkSession
    t = Fraction(str(threshold))
    ordered, frequent = ordered_sets(classes, t, block)
    ordered = materialize(ordered, "ordered_sets")
    entries = with_partners(list_entries(ordered, frequent, t, block), t)
    rows = entries.select("token", "second", "i", "j", "own", "rep", "n", "at").join(ordered.select("rep", "s"), "rep")
    rows = rows.select("token", "second", "i", "j", "own", "rep", "n", "at", "s")
    rows = rows.repartition("token", "second", "i", "j").sortWithinPartitions("token", "second", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        index: list = []
        probe: list = []
        out: list[tuple[int, int, int]] = []

        def flush() -> None:
            if key is None:
                return
            first = key[:1] if key[0] == key[1] else key[:2]
            if key[2] == key[3]:
                if len(index) > 1:
                    out.extend(join_block(first, index, None, t))
            elif index and probe:
                out.extend(join_block(first, index, probe, t))

        def batch() -> pa.RecordBatch:
            columns = zip(*out) if out else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep_1", "rep_2", "common"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in range(8)]
            starts = b.column(8).offsets.to_pylist()
            tokens = b.column(8).values.to_pylist()
            for k, (token, second, i, j, own, rep, n, at) in enumerate(zip(*cols)):
                if (token, second, i, j) != key:
                    flush()
                    key, index, probe = (token, second, i, j), [], []
                (index if own == i else probe).append((rep, n, at, tokens[starts[k] : starts[k + 1]]))
            if len(out) > 50_000:
                yield batch()
                out.clear()
        flush()
        yield batch()

    return rows.mapInArrow(run, "rep_1 bigint, rep_2 bigint, common bigint")


def similar_pairs(df: DataFrame, record: str, values: str, threshold: float, least_size: int = 4, least_value: int = 1, block: int = BLOCK) -> DataFrame:
    """(id_1, id_2): all pairs of records whose sets have a Jaccard similarity of at least ``threshold``.

    Records with a null array, a null id or fewer than ``least_size`` values take
    no part; nulls, repeats and values below ``least_value`` are no part of a set;
    a record delivered twice counts once (of different sets, that of the least
    fingerprint). The smaller id comes first. Records with
    equal sets are pairs as well: they are found as one class and expanded at the
    end. An empty table gives no rows; other columns of ``df`` are ignored.
    """
    members, classes, spent = classes_of(as_sets(df, record, values, least_size, least_value))
    pairs = similar_classes(classes, threshold, block).select("rep_1", "rep_2")
    discard(*spent)  # the sets are stored in their order by now
    return expand_pairs(members, pairs)


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of records from pairs of classes; a large class is spread over tasks.

    ``members`` is joined twice; a class's rows meet all rows of its partner
    class, which is the size of the result.
    """
    sizes = hot_keys(members, "rep", least=1_000)
    spread = HotKeys(sizes.total, 1_000, sizes.counts, sizes.rows)
    own = members.select(F.col("id").alias("id_1"), "rep")
    again = members.select(F.col("id").alias("id_2"), "rep")
    same = salted_lookup(own, again, "rep", spread, ["id_1"]).filter("id_1 < id_2").select("id_1", "id_2")
    left = salted_lookup(own.withColumnRenamed("rep", "rep_1"), pairs, "rep_1", spread, ["id_1"]).withColumnRenamed("rep_2", "rep")
    across = salted_lookup(left, again, "rep", spread, ["id_1"])
    return same.unionByName(across.select(F.least("id_1", "id_2").alias("id_1"), F.greatest("id_1", "id_2").alias("id_2")))


def similarity_links(df: DataFrame, record: str, values: str, threshold: float, least_size: int = 4, least_value: int = 1) -> DataFrame:
    """(id, rep, links): each record with its class and its number of similar records.

    The compact form of the join: copies are not expanded into pairs. ``links``
    counts the other members of the record's class and all members of similar
    classes. Nulls, repeats and empty tables as in ``similar_pairs``.
    """
    members, classes, spent = classes_of(as_sets(df, record, values, least_size, least_value))
    pairs = materialize(similar_classes(classes, threshold).select("rep_1", "rep_2"), "class_pairs")
    discard(*spent)
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.unionByName(pairs.select(F.col("rep_2").alias("rep_1"), F.col("rep_1").alias("rep_2")))
    near = salted_lookup(both, sizes.withColumnRenamed("rep", "rep_2"), "rep_2", hot_keys(both.select("rep_2"), "rep_2"), ["rep_1"]).groupBy("rep_1").agg(F.sum("n").alias("near"))
    linked = sizes.join(near.withColumnRenamed("rep_1", "rep"), "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return salted_lookup(members, linked, "rep", hot_keys(members, "rep"), ["id"]).select("id", "rep", "links")
