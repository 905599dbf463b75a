"""Session helpers: the shared scratch folder and tables that cut lineage.

Iterative operators cut their lineage by writing a table into the folder that
``spark.checkpoint.dir`` names, so a lost executor costs a re-read and not a
recomputation. A machine-local folder is used only where that setting is unset
and the master is local, as in tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def build_session(app: str = "weftgraph", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder of its own; on a
    cluster an unset folder is an error, for a local one would lose data.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below the shared one; removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_dir(spark)}/weft-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared scratch folder and return a read of it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def measured(df: DataFrame, label: str, **aggs: Column) -> tuple[DataFrame, dict]:
    """``materialize`` and aggregates over the rows, taken while they are written; an empty table may give none."""
    seen = Observation()
    table = materialize(df.observe(seen, *[a.alias(n) for n, a in aggs.items()]), label)
    try:
        return table, dict(seen.get)
    except Py4JJavaError:  # the plan of an empty table has no place to observe
        return table, {}


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing will read any more."""
    for table in tables:
        _remove(table.sparkSession, table._scratch)


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session, at least one per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer splits than there are cores, as small files do; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def micros(df: DataFrame, name: str):
    """Microseconds since 1970 of a timestamp column, free of the session's zone for NTZ columns."""
    kind = dict(df.dtypes)[name]
    col = F.col(name)
    if kind == "timestamp":
        return F.unix_micros(col)
    if kind == "timestamp_ntz":
        day = F.unix_date(F.to_date(col)) * F.lit(86_400_000_000)
        clock = F.hour(col) * F.lit(3_600_000_000) + F.minute(col).cast("bigint") * 60_000_000
        return day + clock + (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("bigint")
    return col.cast("bigint")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="weftgraph-zip-")) / "weftgraph.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, file.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
