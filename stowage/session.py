"""Session settings and the one place where iterative jobs cut their lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings that suit every job of this package. They are SQL settings, so a caller's
# running session can take them too.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # What one task reads of a shuffle is bounded, so its memory does not follow the input.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # Paths are stored some five times smaller than they are in memory, where broadcast tables lie.
    "spark.sql.sources.fileCompressionFactor": "5.0",
    # Tables laid out by one column also serve joins on that column and others.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}
PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Bytes of Parquet input to a shuffle partition; rows of two paths are some ten times as large in memory.
BYTES_PER_PARTITION = 8 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators count on to a running session."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle begins with; adaptive planning joins small ones."""
    return int(spark.conf.get(PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def fit_partitions(spark: SparkSession, *paths: str) -> int:
    """Let shuffles begin with as many parts as the files at `paths` ask for, at least; returns how many they begin with.

    A table in fewer buckets than that would be shuffled again by joins on its own keys.
    """
    total = 0
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        total += files.getContentSummary(path).getLength() if files.exists(path) else 0
    asked = max(spark.sparkContext.defaultParallelism, -(-total // BYTES_PER_PARTITION))
    if asked > partitions(spark):
        spark.conf.set(PARTITIONS, asked)
    return partitions(spark)


def local_session(app: str, cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: the session's own setting, else one in its warehouse.

    Both are reachable from all executors, unlike the temporary folder of one machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def working_folder(spark: SparkSession) -> str:
    """Where a job of this session keeps intermediate tables; may be deleted when it is done."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def settle(df: DataFrame) -> tuple[DataFrame, int]:
    """Compute `df` once into a table of the working folder; return that with its row count.

    The count rides along with the write as an observed metric, so a loop that needs both
    "the next frontier" and "is it empty" runs one job per round. A retried task may make
    the metric too high, never too low: fit for emptiness tests and broadcast bounds.

    A table rather than a checkpoint, because a checkpointed frame drags the constraints of
    all earlier rounds along, which makes planning a long loop slower and slower.
    """
    kept, seen = settle_observed(df, rows=F.count(F.lit(1)))
    return kept, int(seen["rows"])


def settle_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Like `settle`, with aggregates of the caller's choice instead of the row count."""
    spark = df.sparkSession
    path = f"{working_folder(spark)}/settled-{uuid.uuid4().hex}"
    observation = Observation()
    named = [column.alias(name) for name, column in metrics.items()]
    df.observe(observation, *named).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), observation.get


def discard(*settled: DataFrame) -> None:
    """Delete the files behind settled frames that nothing will read again.

    Files of any other origin are left alone, so a frame that may or may not be settled is fine.
    """
    for df in settled:
        context = df.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if f"/{context.applicationId}/settled-" in folder:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query are deleted when it ends, so those of many `settle`s do not add up on disk."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def settle_partitioned(df: DataFrame, *keys: str) -> DataFrame:
    """Settle `df` hash-partitioned by `keys`, and known to Spark as such.

    Joins on the same keys then shuffle only their other side.
    """
    spark = df.sparkSession
    path = f"{working_folder(spark)}/settled-{uuid.uuid4().hex}"
    parts = partitions(spark)
    return store_partitioned(df.repartition(parts, *keys), path, parts, *keys)


def settle_distinct(df: DataFrame) -> tuple[DataFrame, int]:
    """The distinct rows of `df`, settled in partitions of all columns, and how many they are."""
    return settle_laid_out(df.repartition(partitions(df.sparkSession), *df.columns).distinct(), *df.columns)


def settle_laid_out(df: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """Settle `df`, already in `partitions` parts by `keys`, and known to Spark as such, with its row count."""
    spark = df.sparkSession
    path = f"{working_folder(spark)}/settled-{uuid.uuid4().hex}"
    kept = store_partitioned(df, path, partitions(spark), *keys)
    return kept, kept.count()


@contextmanager
def kept_buckets(spark: SparkSession) -> Iterator[None]:
    """Within, a scan of a bucketed table has a task per bucket even where no join or grouping asks for it."""
    setting = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def store_partitioned(df: DataFrame, path: str, parts: int, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Write `df`, partitioned by `keys`, to `path` in buckets of them, a file each; reads it back as a bucketed table."""
    spark = df.sparkSession
    name = f"stowage_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd")
    writer.bucketBy(parts, *keys).sortBy(*(order or keys)).option("path", path).saveAsTable(name)
    table = spark.table(name)
    # The frame knows its files and buckets; the caller's catalogue keeps no name, the files stay.
    spark.sql(f"DROP TABLE {name}")
    return table
