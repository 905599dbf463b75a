"""Level-synchronous traversals: breadth-first trees, shortest paths, many searches at once.

The two columns of the edges that a search needs are written once. Each round
joins the frontier with them and removes what was visited. The round's new rows are
written to the shared scratch folder; at most ``MOST_TABLES`` of these tables make the
visited ones, so the plan of a round does not grow with the depth. Driver state is the
number of rows per round.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import materialize, measured

#: Levels of a search that are kept as tables of their own.
MOST_TABLES = 24
#: Words of 64 searches in a row.
MOST_WORDS = 24


def _of_type(edges: DataFrame, etype: int | None) -> DataFrame:
    rows = edges if etype is None else edges.filter(F.col("etype") == etype)
    return rows.select("src", "dst")


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def bfs(edges: DataFrame, start: int, etype: int | None = None, max_depth: int | None = None, until: int | None = None) -> DataFrame:
    """(id, level, parent) of the vertices reached from ``start``; the start is its own parent.

    A vertex's parent is the least one on the level before. Parallel edges and
    self-loops are harmless. With ``until`` the search stops on the level that
    reaches it.
    """
    links = materialize(_of_type(edges, etype), "links")
    spark = edges.sparkSession
    level = 0
    frontier = spark.createDataFrame([(start, 0, start)], "id bigint, level int, parent bigint")
    found = [frontier]
    while max_depth is None or level < max_depth:
        level += 1
        seen = reduce(DataFrame.unionByName, found).select("id")
        steps = links.join(frontier.select(F.col("id").alias("src")), "src")
        fresh = steps.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent")).join(seen, "id", "left_anti")
        hit = F.max(F.col("id") == until) if until is not None else F.lit(False)
        frontier, seen_now = measured(fresh.select("id", F.lit(level).alias("level"), "parent"), f"bfs{level}", n=F.count(F.lit(1)), hit=hit)
        if not seen_now.get("n"):
            break
        found.append(frontier)
        if len(found) > MOST_TABLES:  # a deep search would else plan a union of one table a level
            found = [materialize(reduce(DataFrame.unionByName, found), "found")]
        if seen_now["hit"]:
            break
    return reduce(DataFrame.unionByName, found)


def path_to(tree: DataFrame, target: int) -> list[int]:
    """The way from ``target`` back to the root; empty if it was not reached."""
    row = tree.filter(F.col("id") == target).first()
    path = []
    while row is not None:
        path.append(row["id"])
        if row["parent"] == row["id"]:
            return path
        row = tree.filter((F.col("id") == row["parent"]) & (F.col("level") == row["level"] - 1)).first()
    return path


def shortest_path(edges: DataFrame, source: int, target: int, etype: int | None = None, max_depth: int = 5, reverse: bool = False) -> list[int]:
    """A shortest directed path of at most ``max_depth`` edges, from ``source`` to ``target``, or with ``reverse`` from target to source; empty if there is none.

    Both ends search at once, the one with fewer new vertices next, and meet halfway. The
    rows of a search carry their way back, which is no longer than the path. Of several
    shortest paths the one is given that, seen from the target, has the least vertex at each step.
    """
    if source == target:
        return [source]
    links = materialize(_of_type(edges, etype), "links")
    spark = edges.sparkSession
    sides = []
    for start, near, far in ((source, "src", "dst"), (target, "dst", "src")):
        rows = spark.createDataFrame([(start, [start])], "id bigint, way array<bigint>")
        sides.append({"near": near, "far": far, "rows": rows, "seen": [rows.select("id")], "n": 1})
    for _ in range(max_depth):
        forward = sides[0]["n"] <= sides[1]["n"]
        side = sides[0 if forward else 1]
        steps = links.join(side["rows"].withColumnRenamed("id", side["near"]), side["near"]).withColumnRenamed(side["far"], "id")
        # a way of the source's side starts at its vertex, one of the target's side at the target
        way = F.concat(F.array("id"), F.col("way")) if forward else F.concat(F.col("way"), F.array("id"))
        fresh = steps.select("id", way.alias("way")).groupBy("id").agg(F.min("way").alias("way"))
        fresh = fresh.join(reduce(DataFrame.unionByName, side["seen"]), "id", "left_anti")
        # where the other side has the vertex too, the two ways make a path
        other = sides[1 if forward else 0]["rows"].withColumnRenamed("way", "other")
        first, last = ("other", "way") if forward else ("way", "other")
        path = F.concat(first, F.slice(last, 2, F.greatest(F.size(last) - 1, F.lit(0))))
        met = fresh.join(other, "id", "left").withColumn("path", F.when(F.col("other").isNotNull(), path))
        fresh, seen = measured(met, "ways", n=F.count(F.lit(1)), path=F.min("path"))
        side["rows"], side["n"] = fresh.select("id", "way"), seen.get("n", 0)
        side["seen"].append(fresh.select("id"))
        if not side["n"]:
            return []
        if seen["path"] is not None:
            return list(seen["path"]) if reverse else list(seen["path"])[::-1]
    return []


def path_frame(spark, path: list[int]) -> DataFrame:
    """(step, id) of a path."""
    return spark.createDataFrame(list(enumerate(path)), "step int, id bigint")


@dataclass(frozen=True)
class Searches:
    """Many searches at once: ``found`` has (block, id, level, w0, w1, ...), the bits of the searches that reach ``id`` on ``level``.

    ``seeds`` has (seed, number). Search ``number`` is bit ``number % 64`` of a word; a row
    holds ``words`` of them, and blocks number the rows that a vertex has for further searches.
    """

    seeds: DataFrame
    found: DataFrame
    words: int
    rounds: int

    def _words(self) -> DataFrame:
        """(level, id, first, bits): each word that is not empty, with the number of its first search."""
        rows = self.found.filter("level > 0").select("level", "id", "block", F.posexplode(F.array(*_names(self.words))).alias("word", "bits"))
        return rows.filter("bits <> 0").select("level", "id", ((F.col("block") * self.words + F.col("word")) * 64).alias("first"), "bits")

    def levels(self) -> DataFrame:
        """(seed, id, level)."""
        rows = self._words().select("level", "id", "first", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
        rows = rows.filter("shiftrightunsigned(bits, bit) & 1 = 1").select((F.col("first") + F.col("bit")).alias("number"), "id", "level")
        return self.seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("level")).unionByName(rows.join(self.seeds, "number").select("seed", "id", "level"))

    def histogram(self) -> DataFrame:
        """(vertex, level1, level2, ...): the counts of ``level_histogram``, from the bits as they are."""
        # 16 bits at a time, so that the sums of a row are few enough to be compiled
        rows = self._words().select("level", "first", "bits", F.explode(F.array(*[F.lit(k) for k in range(0, 64, 16)])).alias("low"))
        rows = rows.select("level", (F.col("first") + F.col("low")).alias("first"), F.expr("shiftrightunsigned(bits, low) & 65535").alias("bits"))
        sums = rows.groupBy("level", "first").agg(*[F.expr(f"sum(shiftright(bits, {k}) & 1)").alias(f"n{k}") for k in range(16)])
        counts = sums.select("level", "first", F.posexplode(F.array(*[f"n{k}" for k in range(16)])).alias("bit", "n"))
        each = [F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).alias(f"level{k}") for k in range(1, self.rounds + 1)]
        table = counts.groupBy((F.col("first") + F.col("bit")).alias("number")).agg(*each)
        filled = [F.coalesce(f"level{k}", F.lit(0).cast("bigint")).alias(f"level{k}") for k in range(1, self.rounds + 1)]
        return self.seeds.join(table, "number", "left").select(F.col("seed").alias("vertex"), *filled)


def _names(words: int) -> list[str]:
    return [f"w{k}" for k in range(words)]


def searches(edges: DataFrame, seeds: DataFrame, rounds: int = 6) -> Searches:
    """Undirected searches from all seeds at once, up to ``rounds`` levels.

    A vertex has one row of bits for up to ``64 * MOST_WORDS`` searches, and a round
    sends such rows along the edges: its cost grows with the edges, and not with the pairs
    of a search and a vertex.
    """
    pairs = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    links = materialize(pairs.select(F.inline(both)), "links")
    numbers = seeds.select(F.col("id").alias("seed")).distinct().withColumn("number", F.row_number().over(Window.orderBy("seed")).cast("bigint") - 1)
    numbers, counted = measured(numbers, "seeds", n=F.count(F.lit(1)))
    n = counted.get("n") or 0
    blocks = max(1, -(-n // (64 * MOST_WORDS)))
    words = max(1, -(-n // (64 * blocks)))
    names = _names(words)
    place = F.col("number") % (64 * words)
    own = [F.when(F.floor(place / 64) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))).otherwise(0).alias(w) for k, w in enumerate(names)]
    frontier = numbers.select(F.floor(F.col("number") / (64 * words)).alias("block"), F.col("seed").alias("id"), F.lit(0).alias("level"), *own)
    found = [frontier]
    any_bit = F.expr(f"({' | '.join(names)}) <> 0")
    for level in range(1, rounds + 1):
        seen = reduce(DataFrame.unionByName, found).groupBy("block", "id").agg(*[F.bit_or(w).alias(f"seen_{w}") for w in names])
        steps = links.join(frontier.select("block", F.col("id").alias("src"), *names), "src")
        reached = steps.groupBy("block", F.col("dst").alias("id")).agg(*[F.bit_or(w).alias(w) for w in names])
        fresh = reached.join(seen, ["block", "id"], "left").select("block", "id", F.lit(level).alias("level"), *[F.expr(f"{w} & ~coalesce(seen_{w}, 0L)").alias(w) for w in names])
        frontier, seen_now = measured(fresh.filter(any_bit), f"multi{level}", n=F.count(F.lit(1)))
        if not seen_now.get("n"):
            break
        found.append(frontier)
        if len(found) > MOST_TABLES:
            found = [materialize(reduce(DataFrame.unionByName, found), "found")]
    return Searches(numbers, reduce(DataFrame.unionByName, found), words, rounds)


def multi_bfs(edges: DataFrame, seeds: DataFrame, rounds: int = 6) -> DataFrame:
    """(seed, id, level) of ``searches``: a row for each vertex that a search reaches."""
    return searches(edges, seeds, rounds).levels()


def level_histogram(levels: DataFrame, rounds: int = 6) -> DataFrame:
    """(vertex, level1, level2, ...): how many vertices each seed reaches on each level."""
    cols = [F.sum(F.when(F.col("level") == k, 1).otherwise(0)).alias(f"level{k}") for k in range(1, rounds + 1)]
    return levels.groupBy(F.col("seed").alias("vertex")).agg(*cols)
