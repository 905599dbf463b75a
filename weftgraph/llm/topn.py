"""Top N items of every group by merging stored sorted runs with a loser tree.

Rows are cut into buckets by group and, within a bucket, into runs by item; a run
is sorted by (group, score descending, ties) and stored whole as files of the shared
folder. A hot group has as many runs as it takes to keep each run small. One task then
merges the runs of a bucket: a loser tree yields their rows in order, and after N
items of a group every run seeks to the next: within a row group by binary search, over
row groups that end before it by their statistics, without reading them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.skew import hot_keys
from weftgraph.session import scratch_path, ship_package

#: Runs into which the rows of a bucket are cut, hot groups aside.
FAN_IN = 4
#: Bytes of a row group of a run before compression, what a seek skips or reads at once.
ROW_GROUP = 1 << 20


class Run:
    """A sorted run, a row group at a time; rows become Python values only when they are looked at."""

    def __init__(self, filesystem: fs.FileSystem, path: str):
        self.file = pq.ParquetFile(filesystem.open_input_file(path))
        self.group, self.skipped = 0, 0
        self.columns: list[np.ndarray] = []
        self.at, self.size = 0, 0
        self._head: tuple | None = None
        self._fill()

    def _fill(self) -> None:
        self.at, self.size, self._head = 0, 0, None
        while not self.size and self.group < self.file.num_row_groups:
            table = self.file.read_row_group(self.group, columns=["g", "down", "tie", "item"])
            self.columns = [table.column(c).to_numpy() for c in ("g", "down", "tie", "item")]
            self.size = table.num_rows
            self.group += 1

    def head(self) -> tuple | None:
        if self._head is None and self.at < self.size:
            self._head = tuple(c[self.at].item() for c in self.columns)
        return self._head

    def advance(self) -> None:
        self.at += 1
        self._head = None
        if self.at >= self.size:
            self._fill()

    def seek_past(self, key: int) -> None:
        """Move to the first row of a group beyond ``key``; row groups that end before it are not read."""
        while self.size and self.columns[0][-1] <= key:
            while self.group < self.file.num_row_groups and self._last(self.group) <= key:
                self.group += 1
                self.skipped += 1
            self._fill()
        if self.size:
            # the next group is near more often than not: double the stride first, then search within it
            keys, stride = self.columns[0], 1
            while self.at + stride < self.size and keys[self.at + stride] <= key:
                stride *= 2
            self.at += int(np.searchsorted(keys[self.at : self.at + stride + 1], key, side="right"))
            self._head = None

    def _last(self, group: int) -> int:
        stats = self.file.metadata.row_group(group).column(0).statistics
        return stats.max if stats is not None and stats.has_min_max else 1 << 63


class LoserTree:
    """Tournament over the heads of runs: inner nodes hold losers, the root the winner."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.n = len(runs)
        self.losers = [-1] * max(1, self.n)
        for leaf in range(self.n - 1, -1, -1):
            self._play(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.runs[a].head(), self.runs[b].head()
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.n) // 2
        while node > 0:
            rival = self.losers[node]
            if rival < 0:
                if building:
                    self.losers[node] = winner
                    return
            elif self._beats(rival, winner):
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def top(self) -> int:
        return self.losers[0]

    def replay(self, leaf: int) -> None:
        self._play(leaf)


def merge_top(runs: list[Run], n: int) -> Iterator[tuple[int, int]]:
    """(group, item) of the first ``n`` different items of each group, in order."""
    runs = [r for r in runs if r.head() is not None]
    if not runs:
        return
    tree = LoserTree(runs)
    group, taken, last = None, 0, None
    while (head := runs[tree.top()].head()) is not None:
        if head[0] != group:
            group, taken, last = head[0], 0, None
        if head != last:
            yield head[0], head[3]
            taken, last = taken + 1, head
        if taken < n:
            runs[tree.top()].advance()
            tree.replay(tree.top())
            continue
        while (head := runs[tree.top()].head()) is not None and head[0] == group:
            leaf = tree.top()
            runs[leaf].seek_past(group)
            tree.replay(leaf)


def store_runs(rows: DataFrame, least: int = 50_000, fan_in: int = FAN_IN) -> tuple[str, int]:
    """Write the sorted runs of (g, down, tie, item); their folder and the number of buckets.

    One exchange by (bucket, run). A run belongs to the items that hash to it, so
    copies of an item meet in one run, side by side, and a group's rows spread over
    the runs it has.
    """
    spark = rows.sparkSession
    hot = hot_keys(rows, "g", least=least)
    buckets = max(1, -(-hot.total // (hot.limit * fan_in)))
    runs = F.lit(fan_in)
    if hot.counts:
        table = hot.table(spark, "g", "bigint").withColumn("_splits", F.greatest(F.col("_splits"), F.lit(fan_in)))
        rows = rows.join(F.broadcast(table), "g", "left")
        runs = F.coalesce("_splits", runs)
    placed = rows.select(
        "g", "down", "tie", "item",
        F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int").alias("bucket"),
        F.pmod(F.xxhash64("item"), runs).cast("int").alias("run"),
    )
    width = buckets * max([fan_in, *(-(-c // hot.limit) for c in hot.counts.values())])
    placed = placed.repartition(max(1, min(width, 4 * buckets * fan_in)), "bucket", "run")
    path = scratch_path(spark, "runs")
    (
        placed.sortWithinPartitions("bucket", "run", "g", "down", "tie", "item")
        .write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).partitionBy("bucket", "run").parquet(path)
    )
    return path, buckets


def top_n_per_group(df: DataFrame, group: str, score: str, tie: str, item: str, n: int, least: int = 50_000, fan_in: int = FAN_IN) -> DataFrame:
    """(group, item): the ``n`` items of the highest ``score`` in each group.

    Ties go to the smaller ``tie``, then the smaller ``item``; an item delivered
    repeatedly counts once. Rows with a null in any of the four columns or a NaN
    score are left out; groups with fewer items give all; an empty table gives no
    rows. Group, tie and item are BIGINT; other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(group).cast("bigint").alias("g"), (-F.col(score).cast("double")).alias("down"),
        F.col(tie).cast("bigint").alias("tie"), F.col(item).cast("bigint").alias("item"),
    ).filter("g is not null and tie is not null and item is not null and down is not null and not isnan(down)")
    path, buckets = store_runs(rows, least, fan_in)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                where = fs.FileSelector(f"{root}/bucket={bucket}", recursive=True, allow_not_found=True)
                files = sorted(f.path for f in filesystem.get_file_info(where) if f.path.endswith(".parquet"))
                groups: list[int] = []
                items: list[int] = []
                for g, i in merge_top([Run(filesystem, f) for f in files], n):
                    groups.append(g)
                    items.append(i)
                    if len(groups) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(items, pa.int64())], names=[group, item])
                        groups, items = [], []
                if groups:
                    yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(items, pa.int64())], names=[group, item])

    ship_package(spark)
    ids = spark.range(0, buckets, 1, min(buckets, 100_000))
    return ids.mapInArrow(merge, f"`{group}` bigint, `{item}` bigint")
