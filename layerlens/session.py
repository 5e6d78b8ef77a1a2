"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", memory: str = "8g", app: str = "layerlens") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where the setting is missing a local session gets a temporary folder; on a cluster that
    is an error, as executors would not find it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
        if context.applicationId not in _local_roots:
            _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="layerlens-")
        root = _local_roots[context.applicationId]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


#: The lists that new folders are noted in, the innermost last.
_noted: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root."""
    folder = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _noted:
        _noted[-1].append(folder)
    return folder


@contextmanager
def noted_folders() -> Iterator[list[str]]:
    """The folders made inside, for one who knows when no later step reads them."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a narrow intermediate table to the shared folder and reads it back.

    Later steps read the stored rows instead of repeating the scan that made them, also
    after executors are lost, and Spark knows the table's size when it plans joins.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Writes a table in buckets of `key`, one per shuffle partition, and reads it back.

    A later join on the key finds these rows where they are, and only the other side moves.
    The table is known to this session's catalog alone; its files are in the shared folder.
    """
    return _in_buckets(df, key, name)[0]


def _in_buckets(df: DataFrame, key: str, name: str) -> tuple[DataFrame, str, str]:
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, name)
    table = f"layerlens_{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        dealt = df.repartition(buckets, key)
        dealt.write.bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(table)
    return spark.table(table), folder, table


#: Removes a query's shuffle files when it ends. A stored result needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The bytes of rows that Spark hands to Python at once.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession):
    """Writes made inside leave no shuffle files behind."""
    return _setting(spark, _CLEANUP, "true")


def short_batches(spark: SparkSession):
    """Writes made inside hand rows to Python in batches of 8 MB, where whole texts may be long."""
    return _setting(spark, _BATCH_BYTES, "8m")


class Scratch:
    """Intermediate tables of one job, each deleted as soon as no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders, self.catalog = spark, {}, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As `written`, and the shuffle files of the write go with it."""
        folder = new_folder(self.spark, name)
        with shuffles_removed(self.spark), short_batches(self.spark):
            df.write.parquet(folder)
        out = self.spark.read.schema(df.schema).parquet(folder)
        self.folders[id(out)] = out, folder
        return out

    def bucketed(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """As `bucketed`; the catalog forgets the table when it is dropped."""
        out, folder, table = _in_buckets(df, key, name)
        self.folders[id(out)], self.catalog[id(out)] = (out, folder), table
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables made here but these."""
        kept = {id(t) for t in tables}
        self.drop(*[t for key, (t, _) in self.folders.items() if key not in kept])

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables made here; others are left alone."""
        for table in tables:
            if id(table) in self.folders:
                dropped(self.spark, self.folders.pop(id(table))[1])
                if id(table) in self.catalog:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self.catalog.pop(id(table))}")


def dropped(spark: SparkSession, *folders: str) -> None:
    """Deletes folders of intermediate tables that no later step reads."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan with fewer splits than cores over all cores; longer scans stay as they are.

    Such a scan is small by its number of splits, so the extra shuffle is small too.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
