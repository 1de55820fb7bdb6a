"""Size-checked broadcasts and staged tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be sent to every task; its rows are narrow.
BROADCAST_ROWS = 200_000


#: Narrow rows that one task may have to sort or hash at once.
TASK_ROWS = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """As many tasks as ``rows`` need at ``TASK_ROWS`` each; a task for each core where there is a tenth of that for it."""
    return max(-(-rows // TASK_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows * 10 // TASK_ROWS)), 1)


@contextlib.contextmanager
def dealing(spark: SparkSession, parts: int, whole_files: bool = False) -> Iterator[None]:
    """While tables are staged: shuffles into ``parts``, none of them put together again, and with ``whole_files`` each written file read by a task of its own (files of narrow rows are small however many rows they hold)."""
    settings = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    if whole_files:
        settings["spark.sql.files.openCostInBytes"] = spark.conf.get("spark.sql.files.maxPartitionBytes")
    held = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the bound, else as it is (the join is then by shuffle)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only on one machine is a temporary folder made where neither is set; on a
    cluster that would be a folder that executors do not share, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='loresmith-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str = "stage") -> str:
    """A new folder name below the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, folder: str) -> str:
    """Have a written folder removed when the application ends; plans that read it live no longer."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once below the cluster's shared folder and read back, so that lineage ends there and no executor's disk holds it."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(until_exit(spark, path))


def staged_and_told(df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
    """:func:`staged`, with aggregates over all rows that are taken while they are written, so that no second job reads them."""
    seen = Observation()
    out = staged(df.observe(seen, *measures))
    return out, seen.get
