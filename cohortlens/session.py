"""Session set-up, and the written tables this library cuts lineage with."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cohortlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes: UTC clock, adaptive execution, skew handling."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Session SQL settings the jobs need, wherever the session came from: the UTC clock and a codegen limit.

    The JVM never compiles methods above 8,000 bytecodes, and a fused stage of many rules easily exceeds that and then
    runs interpreted. With this limit Spark falls back to smaller generated methods, which do get compiled.
    """
    # Windows, source-local times and stored timestamps are all compared in UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # A write into a few folders keeps one open file each instead of sorting its rows by folder first.
    if spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0":
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "4")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only on a local master, where nothing else is possible."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        own = tempfile.mkdtemp(prefix="cohortlens-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate, under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write an intermediate as Parquet in the shared folder and read it back.

    Lineage ends there, so a lost executor costs a re-read. Later steps prune columns and push filters into the copy,
    and Catalyst knows its size: joins against small results are broadcast because they were measured, not hinted.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Stage an aggregated table (metrics, candidates, verdicts) that several later steps read."""
    return stage(df)


#: Most rows of a file that `small_tasks` is to read: one file is one task's at least, as Parquet isn't cut inside a row group.
FILE_ROWS = 1_000_000


@contextmanager
def small_tasks(spark: SparkSession, read: int = 32 << 20, moved: int = 16 << 20):
    """What runs inside has tasks over at most so many bytes of files, and of shuffled rows where adaptive execution sets their sizes.

    For aggregations with about as many groups as rows: a task's groups then fit its memory, where those of 128 MB of files are spilled.
    """
    wanted = {"spark.sql.files.maxPartitionBytes": read, "spark.sql.adaptive.advisoryPartitionSizeInBytes": moved}
    size_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {k: spark.conf.get(k) for k in wanted}
    for k, most in wanted.items():
        spark.conf.set(k, str(min(most, size_of(before[k]))))
    try:
        yield
    finally:
        for k, was in before.items():
            spark.conf.set(k, was)


def occupy(df: DataFrame) -> DataFrame:
    """A plain scan with fewer input splits than cores, such as one small or unsplittable file, dealt to all cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
