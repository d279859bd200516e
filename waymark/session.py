"""Session settings, the written tables that cut the lineage of iterative jobs, and the package's way to the executors."""

from __future__ import annotations

import io
import pathlib
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cpus: str = "*", app: str = "waymark", shared: str | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks, with ``shared`` as the folder of intermediate tables. On a
    cluster pass the cluster's own session."""
    partitions = "8" if cpus == "*" else str(max(int(cpus), 2))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the session names in ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
    return configured.rstrip("/")


TASK_ROWS = 2_000_000  # rows that a task is to sort or gather at most, where their number is known


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Hash partitions by key in the number that the session sets for shuffles, or more where ``rows`` rows need them.

    For steps that cost much time per row: the rows are few bytes, so adaptive execution would merge them into few
    tasks. With ``rows`` also for those that cost memory per row: a task's share stays the same however many rows there are.
    A following grouping by the same keys, or by these and others, uses these partitions without another shuffle.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


# ---- written tables --------------------------------------------------------------------------------------------------

_written: list[str] = []


def scratch_folder(spark: SparkSession, kind: str = "waymark") -> str:
    """A new folder of the shared one, which ``release`` deletes."""
    path = f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the intermediate tables that this process wrote, from the ``since``-th on; call it once their results are stored."""
    gone = _written[since:]
    del _written[since:]
    _delete(spark, gone)
    return len(gone)


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for name in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """A step that stores its result itself: the intermediate tables it wrote go when it ends, as for a batch of a stream."""
    since = len(_written)
    try:
        yield
    finally:
        release(spark, since)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: ends the lineage, and survives the loss of an executor."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_and_measure(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """As ``cut``, with aggregates taken while the rows are written, so that they cost no second pass."""
    seen = Observation()
    return cut(df.observe(seen, *[c.alias(name) for name, c in measures.items()])), seen.get


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of an action go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def cut_lean(df: DataFrame) -> DataFrame:
    """As ``cut``, for jobs whose tables and shuffles together would fill the disk: smaller files, and the shuffles behind them go at once."""
    path = scratch_folder(df.sparkSession)
    with _freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lean_and_measure(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    seen = Observation()
    return cut_lean(df.observe(seen, *[c.alias(name) for name, c in measures.items()])), seen.get


def tables_written() -> int:
    """How many tables were written so far, as a mark for ``release_unread``."""
    return len(_written)


def release_unread(since: int, *read: DataFrame) -> int:
    """Delete the tables written from the ``since``-th on that none of the frames ``read`` is made of: a step's own tables, once its results are written."""
    spark, used = read[0].sparkSession, set()
    for df in read:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if leaf.nodeName().startswith("LogicalRelation"):
                used |= set(leaf.relation().location().rootPaths().mkString("\n").split("\n"))
    used = {path.rstrip("/").rsplit("/", 1)[-1] for path in used}
    gone = [path for path in _written[since:] if path.rsplit("/", 1)[-1] not in used]
    _written[since:] = [path for path in _written[since:] if path not in gone]
    _delete(spark, gone)
    return len(gone)


def cut_large(df: DataFrame) -> DataFrame:
    """As ``cut``, for tables that grow with the input: their joins shuffle. Without the hint Spark would broadcast them by their compressed
    size on disk, and the driver would hold relations many times as large, all those of a plan at once."""
    return cut(df).hint("merge")


def cut_large_and_measure(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    table, seen = cut_and_measure(df, **measures)
    return table.hint("merge"), seen


def cut_large_lean(df: DataFrame) -> DataFrame:
    """As ``cut_large`` and ``cut_lean``."""
    return cut_lean(df).hint("merge")


def cut_large_lean_and_measure(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    table, seen = cut_lean_and_measure(df, **measures)
    return table.hint("merge"), seen


# ---- executors ---------------------------------------------------------------------------------------------------------

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once per application.

    Needed where the workers have not installed it; the archive goes through the shared folder.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent).as_posix())
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{root.name}-{uuid.uuid4().hex}.zip")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(archive.getvalue()))
    stream.close()
    context.addPyFile(path.toString())
    _shipped.add(context.applicationId)
