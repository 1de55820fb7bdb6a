"""Staged tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, never by local checkpoints: a lost executor takes nothing with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_base, until_exit

#: A side is broadcast only when its counted rows times its row width stay below this many bytes.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; a temporary one only on one machine (tests)."""
    return f"{shared_base(spark)}/loresmith-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch that goes to a worker, where the session still has Spark's default of 64 MB.
BATCH_BYTES = "4m"
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64m", "67108864")


def small_batches(spark: SparkSession) -> SparkSession:
    """Lower the session's Arrow batch size unless somebody has set it: texts are long, and a batch stands in memory on both sides of the pipe."""
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT[0]) in _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    return spark


def stage(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(until_exit(spark, path))


def discard(folder: str, spark: SparkSession) -> None:
    """Remove a staged folder that no returned plan reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``df`` (already staged, so that counting is cheap) with a broadcast hint if its counted size is within the bound."""
    limit = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))
