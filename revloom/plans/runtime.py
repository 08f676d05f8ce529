"""Session services: shared scratch space for checkpoints and written tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode and only where the setting is missing.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="revloom-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing uses yet."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# of settled tables
CODEC = "zstd"


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and go on from the written table.

    Ends the lineage like a checkpoint and survives lost executors; being Parquet, later steps read only
    the columns they need and the planner knows the size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path, compression=CODEC)
    return spark.read.schema(df.schema).parquet(path)


# input of one shuffle partition, as Parquet; rows are several times as large in a task's memory
PARTITION_BYTES = 4 << 20
# shuffled bytes that adaptive execution joins into one task: rows of long paths are ten times and more as large in memory
TASK_BYTES = 16 << 20


def byte_size(spark: SparkSession, text: str) -> int:
    """Bytes of a size as settings give it, such as 64MB."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


def size_partitions(spark: SparkSession, *paths: str, bytes_each: int = PARTITION_BYTES) -> int:
    """Raise ``spark.sql.shuffle.partitions`` to what the largest of the inputs needs, so that a task's share does not grow
    with them; adaptive execution joins partitions that turn out small, up to TASK_BYTES. Never lowered, and the size of a
    task never raised. Returns the number."""
    conf, largest = spark._jsc.hadoopConfiguration(), 0
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(conf)
        if files.exists(target):
            largest = max(largest, files.getContentSummary(target).getLength())
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-largest // bytes_each))
    spark.conf.set("spark.sql.shuffle.partitions", str(number))
    joined = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if byte_size(spark, spark.conf.get(joined)) > TASK_BYTES:
        spark.conf.set(joined, str(TASK_BYTES))
    return number


class Scratch:
    """Settled tables of one computation.

    Used as a context: on leaving it every table is removed but those settled with ``keep=True``, which
    a lazy result still reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, []

    def settle(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = scratch_path(self.spark, "table")
        if not keep:
            self._paths.append(path)
        df.write.parquet(path, compression=CODEC)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for path in self._paths:
            remove_path(self.spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library in whatever store holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
