"""Passage vectors of scenes as Parquet: created once, opened with checks, read by scene."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.retrieval import unit, vector_fault
from .bundles import exists, move

FORMAT = "loresmith-passages-1"
#: Texts to vectors; ``kind`` is "document" or "query".
Embed = Callable[[Sequence[str], str], Sequence[Sequence[float]]]
SCENE = "mission string, heading string, path string, phase string, passages array<struct<line:int,text:string,role:string>>"


def scene_id() -> Column:
    """The name of a scene: a hash of all its fields, in which an absent phase is not an empty one."""
    fields = F.to_json(F.struct("mission", "heading", "path", "phase", "passages"), {"ignoreNullFields": "false"})
    return F.concat(F.lit("scene-"), F.sha2(fields, 256))


def authored(scenes: DataFrame) -> DataFrame:
    """Scenes by name, each once."""
    named = scenes.select(scene_id().alias("scene_id"), "mission", "heading", "path", "phase", "passages")
    return named.dropDuplicates(["scene_id"])


def passages_of(scenes: DataFrame) -> DataFrame:
    """(scene_id, passage_index, passage_id, line, text): each passage under its heading, options marked."""
    p = scenes.select("scene_id", "heading", F.posexplode("passages").alias("passage_index", "p"))
    text = F.concat("heading", F.lit("\n"), F.when(F.col("p.role") == "option", "Player choice: ").otherwise(""), "p.text")
    name = F.sha2(F.concat_ws("\x01", "scene_id", F.col("passage_index").cast("string"), F.col("p.line").cast("string"), "p.text", "p.role"), 256)
    return p.select("scene_id", "passage_index", F.concat(F.lit("passage-"), name).alias("passage_id"), F.col("p.line").alias("line"), text.alias("text"))


class SceneIndex:
    """``scenes`` and ``passages`` (with unit vectors) of a written index."""

    def __init__(self, spark: SparkSession, path: str, identity: str):
        if not exists(spark, f"{path}/metadata"):
            raise FileNotFoundError(path)
        told = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        if told["format"] != FORMAT or told["embedder"] != identity:
            raise ValueError("the index has another format or was made by another encoder")
        self.spark, self.path, self.dimension = spark, path, told["dimension"]
        self.scenes, self.passages = spark.read.parquet(f"{path}/scenes"), spark.read.parquet(f"{path}/passages")

    @classmethod
    def create(cls, scenes: DataFrame, path: str, embed: Embed, identity: str) -> SceneIndex:
        """Embed all passages and publish the index by one rename; an index that is there is never replaced, and a vector that is not sound stops it."""
        spark = scenes.sparkSession
        if not identity:
            raise ValueError("the encoder must have a name")
        if exists(spark, path):
            raise FileExistsError(path)
        building = f"{path.rstrip('/')}.building"

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def vector(text: pd.Series) -> pd.Series:
            made = list(embed(text.tolist(), "document"))
            if len(made) != len(text):
                raise ValueError("the encoder returned another number of vectors")
            return pd.Series([[float(x) for x in v] for v in made])

        authored(scenes).write.mode("overwrite").parquet(f"{building}/scenes")
        passages = passages_of(spark.read.parquet(f"{building}/scenes"))
        passages.withColumn("vector", vector("text")).write.mode("overwrite").parquet(f"{building}/raw")
        raw = spark.read.parquet(f"{building}/raw")
        first = raw.select(F.size("vector")).first()
        if first is None:
            raise ValueError("there is no passage to index")
        wrong = raw.select(vector_fault(F.col("vector"), first[0]).alias("f")).where("f IS NOT NULL").first()
        if wrong:
            raise ValueError(f"a vector cannot be indexed: {wrong.f}")
        raw.withColumn("vector", unit(F.col("vector"))).write.parquet(f"{building}/passages")
        fs = spark._jvm.org.apache.hadoop.fs.Path(f"{building}/raw")
        fs.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs, True)
        spark.createDataFrame([(json.dumps({"format": FORMAT, "embedder": identity, "dimension": first[0]}),)], "value string").coalesce(1).write.text(f"{building}/metadata")
        move(spark, building, path)
        return cls(spark, path, identity)

    def faults(self) -> DataFrame:
        """(name, fault): scenes whose content is not what their name says, and passages that are missing, foreign or changed."""
        renamed = self.scenes.where(scene_id() != F.col("scene_id")).select(F.col("scene_id").alias("name"), F.lit("content differs from its name").alias("fault"))
        expected = passages_of(self.scenes).select("passage_id", F.col("text").alias("expected"))
        both = expected.join(self.passages.select("passage_id", "text"), "passage_id", "full")
        fault = F.when(F.col("text").isNull(), "missing").when(F.col("expected").isNull(), "foreign").when(F.col("text") != F.col("expected"), "changed")
        return renamed.unionByName(both.select(F.col("passage_id").alias("name"), fault.alias("fault")).where("fault IS NOT NULL"))
