"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "themeforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_themeforge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="themeforge-zip-")) / "themeforge.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._themeforge_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster,
    executors must all see the same storage.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to storage that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="themeforge-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def spread_texts(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Deal texts to ``partitions`` tasks before they are tokenised; off by default.

    Without the argument the session's ``spark.themeforge.textPartitions`` counts, and
    without that the scan's own splits stay: large inputs have more of them than there
    are cores, and their text then never goes through a shuffle. Set it only where one
    file of a single row group would keep most cores idle.
    """
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.themeforge.textPartitions", "0"))
    return df.repartition(partitions, key) if partitions else df


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    For tables that several branches of a plan read: the branches then scan
    only the columns they need, and a lost executor costs a re-read. What the write
    shuffled goes with its end; else it stays on disk until the driver collects its garbage.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    held = spark.read.schema(df.schema).parquet(path)
    held._themeforge_path = path
    return held


def unstage(*tables: DataFrame) -> None:
    """Remove the files of staged tables that nothing reads any more; other tables stay as they are."""
    for table in tables:
        path = getattr(table, "_themeforge_path", None)
        if path is not None:
            spark = table.sparkSession
            held = spark._jvm.org.apache.hadoop.fs.Path(path)
            held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


def reliable(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, keeping partition order and contents fixed."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
