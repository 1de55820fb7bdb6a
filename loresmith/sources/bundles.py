"""Datasets as bundles: a folder of parts and a manifest that vouches for each; and JSON-lines records with located errors."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query, table
from ..operators.contracts import assigned_split, turns
from ..operators.shared import shared_folder, until_exit

FORMAT = "loresmith-scenes-1"
SPLITS = ("train", "validation", "test")
_RECORD = "schema_version int, metadata struct<id:string,split:string,mission:string>, messages array<struct<role:string,content:string>>"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not publish {target}")


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """(artifact, sha256, bytes) of the data files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.regexp_extract("path", r"((?:split=[^/]+/)?part-[^/]+)$", 1).alias("artifact"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def write_bundle(records: DataFrame, output: str, split_col: str = "split") -> None:
    """Publish records by split, all or nothing: parts and manifest are written beside the target and put in place by one rename."""
    spark = records.sparkSession
    if exists(spark, output):
        raise FileExistsError(output)
    staging = f"{output.rstrip('/')}.building-{uuid.uuid4().hex}"
    records.write.partitionBy(split_col).json(f"{staging}/records")
    manifest_of(spark, f"{staging}/records").withColumn("format", F.lit(FORMAT)).write.json(f"{staging}/manifest")
    move(spark, staging, output)


def bundle_faults(spark: SparkSession, root: str) -> DataFrame:
    """(artifact, fault) of a bundle: another format, a missing, foreign or changed file."""
    told = spark.read.schema("artifact string, sha256 string, bytes long, format string").json(f"{root}/manifest")
    there = manifest_of(spark, f"{root}/records").select("artifact", F.col("sha256").alias("found"))
    fault = F.when(F.col("sha256").isNull(), "not in the manifest").when(F.col("found").isNull(), "missing").when(F.col("format") != FORMAT, "format").when(F.col("sha256") != F.col("found"), "hash differs")
    return told.join(there, "artifact", "full").select("artifact", fault.alias("fault")).where("fault IS NOT NULL")


def physical_aliases(root: str) -> list[tuple[str, str]]:
    """Pairs of names below a local folder that are one file on its disk: an artifact that stands in for another would pass every hash.

    Stores without such links (any path that is not local) have none.
    """
    local = root.removeprefix("file://")
    if not local.startswith("/"):
        return []
    first: dict[tuple[int, int], str] = {}
    found = []
    for folder, _, names in sorted(os.walk(local)):
        for name in sorted(names):
            path = os.path.join(folder, name)
            told = os.stat(path)
            key = (told.st_dev, told.st_ino)
            if key in first:
                found.append((first[key], os.path.relpath(path, local)))
            else:
                first[key] = os.path.relpath(path, local)
    return found


def read_bundle(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """The records of a bundle, of one split or all, after the whole bundle has been checked."""
    if alias := physical_aliases(root):
        raise ValueError(f"two artifacts are one file: {alias[0]}")
    wrong = bundle_faults(spark, root).limit(5).collect()
    if wrong:
        raise ValueError(f"dataset artifact differs: {[tuple(r) for r in wrong]}")
    rows = spark.read.json(f"{root}/records")
    if split is not None and split not in SPLITS:
        raise ValueError(f"split was not prepared: {split}")
    return rows if split is None else rows.where(F.col("split") == split)


def read_records(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """JSON-lines records with their file, line and fault (null if sound); blank lines are passed over.

    A line's number follows from the lines before it in its part of the file:
    files are read one to a part, which keeps physical order.
    """
    lines = spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n", -1)).alias("line", "text"))
    lines = lines.where(~F.col("text").rlike(r"(?U)^\s*\z")).withColumn("line", F.col("line") + 1)
    whole = F.from_json("text", _RECORD + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    version = F.get_json_object("text", "$.schema_version")
    rows = lines.withColumn("record", whole)
    keys = F.array_sort(F.json_object_keys("text"))
    fault = (
        F.when(keys.isNull(), "not a record")
        .when(keys != F.array(*map(F.lit, ("messages", "metadata", "schema_version"))), "fields")
        .when(~F.coalesce(version == "1", F.lit(False)) | F.col("text").rlike(r'"schema_version"\s*:\s*(true|")'), "schema version")
        .when(F.col("record._corrupt").isNotNull(), "types")
        .when(F.lit(split is not None) & ~F.coalesce(F.col("record.metadata.split") == F.lit(split), F.lit(False)), "split")
        .when(~F.coalesce(F.col("record.metadata.id").rlike(r"^[a-z0-9]+(?:[-_][a-z0-9]+)*\z"), F.lit(False)), "id")
    )
    return rows.select("path", "line", fault.alias("fault"), F.col("record.schema_version").alias("schema_version"), F.col("record.metadata").alias("metadata"), F.col("record.messages").alias("messages"))


@query("""WITH s AS (SELECT conv_id, count(*) AS messages, ('0x' || left(sha256(conv_id::VARCHAR), 8))::BIGINT % 10 AS b FROM conversations GROUP BY conv_id)
    SELECT CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'validation' ELSE 'test' END AS split, count(*) AS records, sum(messages)::BIGINT AS messages FROM s GROUP BY 1""")
def bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations published as a bundle by split, checked and read back."""
    output = shared_folder(spark, "bundle")
    records = turns(table(spark, sf_dir, "conversations")).select("conv_id", "messages", assigned_split(F.col("conv_id").cast("string")).alias("split"))
    write_bundle(records, output)
    return read_bundle(spark, until_exit(spark, output)).groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("messages")).alias("messages"))
