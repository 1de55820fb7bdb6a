"""Plain files of results and runs: JSON and JSON lines read with a schema, single documents created once or replaced whole, rows appended."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalogue import query, table
from ..functions.text import canonical
from ..operators.assessment import refusing
from ..operators.shared import shared_folder, until_exit


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; blank lines are passed over, a line that is no JSON of it ends the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files of JSON, a row for each document."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str):
    """One small document, on the driver."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_results(spark: SparkSession, folder: str, schema: str, suffix: str = ".result.json") -> DataFrame:
    """The result files of a folder, ``sample_id`` being the file's name before the suffix."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").option("pathGlobFilter", f"*{suffix}").json(folder)
    name = F.regexp_replace(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)), F.lit(suffix.replace(".", r"\.") + "$"), F.lit(""))
    return rows.select(name.alias("sample_id"), *rows.columns)


def _write(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def create_json(spark: SparkSession, path: str, value) -> None:
    """Write one small document where none is; one that is there is never replaced."""
    p, fs = _path(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    _write(spark, path, json.dumps(value, ensure_ascii=False, indent=1, allow_nan=False) + "\n", False)


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """The same for text."""
    p, fs = _path(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    _write(spark, path, text, False)


def replace_json(spark: SparkSession, path: str, value) -> None:
    """Put a document in place of another by one rename, so that a reader sees the old or the new one, whole."""
    _write(spark, f"{path}.tmp", json.dumps(value, ensure_ascii=False, allow_nan=False) + "\n", True)
    jvm = spark._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    p, fs = _path(spark, path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(jvm.org.apache.hadoop.fs.Path(f"{path}.tmp"), p, overwrite)


@F.pandas_udf(T.StringType())
def canonical_line(document: pd.Series) -> pd.Series:
    """A JSON document written canonically: sorted keys, raw characters."""
    return document.map(lambda x: None if x is None else canonical(json.loads(x)))


def append_rows(rows: DataFrame, folder: str) -> None:
    """Add rows to a folder of JSON lines in canonical writing, nulls as nulls; what is there stays."""
    line = canonical_line(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    rows.select(line.alias("value")).write.mode("append").text(folder)


def write_rows(rows: DataFrame, folder: str) -> None:
    """JSON lines in canonical writing in a folder that must not be there: the contexts that a training run used, say."""
    line = canonical_line(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    rows.select(line.alias("value")).write.mode("errorifexists").text(folder)


RESPONSE = "sample_id string, status string, response string, error string, finish_reason string, elapsed_seconds double, input_tokens long, output_tokens long"


def viewer_run(spark: SparkSession, folder: str, manifest_sha256: str, samples: DataFrame) -> tuple[dict, DataFrame]:
    """What a viewer shows of a run: its description, and (sample_id, place, status, response, ...) for each selected sample; status is null where there is no response.

    Two layouts are known: a benchmark (``selection.json`` beside the folder, a
    result file for each sample) and a generation run (``run.json`` and
    ``responses.jsonl`` in it).  A run of another dataset, unknown or repeated
    samples, a response of none of them or with a status that is neither ok nor
    failed, is refused.
    """
    beside = folder.rstrip("/").rsplit("/", 1)
    p, fs = _path(spark, f"{beside[0]}/selection.json")
    if fs.exists(p):
        told = read_json(spark, f"{beside[0]}/selection.json")
        info = {"name": beside[1], "manifest_sha256": told["manifest_sha256"], "selected_ids": told["ids"]}
        responses = read_results(spark, folder, RESPONSE.split(", ", 1)[1])
        responses = responses.join(_listed(spark, told["ids"]).select("sample_id"), "sample_id", "left_semi")
    else:
        told = read_json(spark, f"{folder}/run.json")
        if told.get("schema_version") != 1 or isinstance(told["schema_version"], bool):
            raise ValueError("the run has another schema")
        info = {"name": beside[1], "status": told.get("status"), "model": told.get("model"), "manifest_sha256": told["dataset"]["manifest_sha256"], "selected_ids": told["dataset"]["sample_ids"]}
        path = f"{folder}/responses.jsonl"
        expected = (told.get("artifacts_sha256") or {}).get("responses.jsonl")
        if expected and spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0] != expected:
            raise ValueError("the responses are not those that the run recorded")
        responses = read_rows(spark, path, RESPONSE)
    if info["manifest_sha256"] != manifest_sha256:
        raise ValueError("the run belongs to another dataset")
    ids = info["selected_ids"]
    listed = _listed(spark, ids)
    unknown = listed.join(samples.select("sample_id"), "sample_id", "left_anti").first()
    if len(set(ids)) != len(ids) or unknown:
        raise ValueError(f"repeated or unknown samples: {unknown and unknown.sample_id}")
    per = responses.groupBy("sample_id").agg(F.count(F.lit(1)).alias("__n"))
    told_rows = responses.join(per, "sample_id").join(listed.select("sample_id", F.lit(True).alias("__in")), "sample_id", "left")
    fault = F.when(F.col("__in").isNull(), "response of no selected sample").when(F.col("__n") > 1, "more than one response").when(~F.coalesce(F.col("status").isin("ok", "failed"), F.lit(False)), "status of a response")
    sound = refusing(told_rows, fault, F.col("sample_id")).drop("__n", "__in")
    return info, listed.join(sound, "sample_id", "left")


def _listed(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "sample_id string, place int")


@query("""SELECT CAST(quality AS VARCHAR) AS status, count(*) AS results, sum(doc_id)::BIGINT AS ids FROM labels GROUP BY quality""")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels appended as JSON lines in two goes, and read again under a schema."""
    folder = until_exit(spark, shared_folder(spark, "rows"))
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("sample_id"), F.col("quality").cast("string").alias("status"), F.lit(None).cast("string").alias("error"))
    for part in (0, 1):
        append_rows(rows.where(F.col("sample_id") % 2 == part), folder)
    read = read_rows(spark, folder, "sample_id long, status string, error string")
    return read.groupBy("status").agg(F.count(F.lit(1)).alias("results"), F.sum("sample_id").alias("ids"))


def by_status(responses: DataFrame) -> Mapping[str, int]:
    """How many selected samples there are of each status; ``missing`` without a response."""
    return {r["s"]: r["n"] for r in responses.groupBy(F.coalesce("status", F.lit("missing")).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
