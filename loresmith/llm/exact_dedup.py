"""Exact duplicates: 128-bit content hash, then a comparison of bytes inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import small, stage, text_or_empty


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash=md5_128) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Rows are grouped by a 128-bit hash of the text; of each group the smallest
    (``keep="min"``) or largest id stays.  Every group of more than one row is
    then grouped again by its text itself, so rows whose hashes collide are told
    apart.  Counts are combined before each shuffle, so a text that a third of
    all rows share sends one row per task.

    Null text counts as empty; empty texts are equal to each other.  Null ids
    count in ``group_size`` and are never chosen unless the group has no other
    id.  The decision is one of (id, text): rows that repeat both get the same,
    and an id that stands beside two texts is decided on for each of them.
    Other columns are ignored, so their names cannot clash.  An empty table
    gives no rows.
    """
    best = F.max if keep == "max" else F.min
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("__id"), content_hash(text).alias("__h"), F.sha2(text.cast("binary"), 256).alias("__sha"))
    groups = stage(base.groupBy("__h").agg(F.count(F.lit(1)).alias("__n"), best("__id").alias("__keep")).where("__n > 1"))
    groups = small(groups, 48)

    texts = docs.select(F.col(id_col).alias("__id"), content_hash(text).alias("__h"), text.alias("__t"))
    suspects = texts.join(groups.select("__h"), "__h", "left_semi")
    variants = suspects.groupBy("__h", "__t").agg(F.count(F.lit(1)).alias("__n"), best("__id").alias("__keep"))
    collided = stage(variants.groupBy("__h").agg(F.count(F.lit(1)).alias("__v")).where("__v > 1").select("__h"))
    result = base.join(groups, "__h", "left")
    if not collided.isEmpty():
        hint = small(collided, 32)
        own = texts.join(hint, "__h", "left_semi").select("__id", "__h", "__t", F.sha2(F.col("__t").cast("binary"), 256).alias("__sha"))
        apart = own.join(variants.join(hint, "__h", "left_semi"), ["__h", "__t"], "left").select(*result.columns)
        result = result.join(hint, "__h", "left_anti").select(*result.columns).unionByName(apart)
    keep_id = F.when(F.col("__n").isNull(), F.col("__id")).otherwise(F.col("__keep"))
    return result.select(
        F.col("__id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep_id).alias("kept"), F.col("__sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` for which :func:`exact_groups` says ``kept``, in all their columns, each (id, text) once.

    So exactly one row of each text stays, whatever ids repeat or are null; of
    rows that are equal in id and text, which one stays is open.
    """
    gone = exact_groups(docs, id_col, text_col, keep).where("NOT kept").select(F.col(id_col).alias("__id"), F.unhex("text_sha256").alias("__sha"))
    return one_of_each(without(docs, gone, id_col, text_col, sha256), id_col, text_col, sha256)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, content_hash) -> DataFrame:
    """The rows of ``docs`` but for those whose id and content hash are among ``gone`` (two columns: id and hash)."""
    gone = small(stage(gone.toDF("__id", "__hash").distinct()), 56)
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (content_hash(text_or_empty(text_col)) == F.col("__hash")), "left_anti")


def one_of_each(docs: DataFrame, id_col: str, text_col: str, content_hash) -> DataFrame:
    """``docs`` with one row of each (id, text); texts move only where they are repeated."""
    key = docs.select(F.col(id_col).alias("__id"), content_hash(text_or_empty(text_col)).alias("__hash"))
    again = stage(key.groupBy("__id", "__hash").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    if again.isEmpty():
        return docs
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (content_hash(text_or_empty(text_col)) == F.col("__hash"))
    again = small(again, 56)
    repeated = docs.join(again, same, "left_semi").withColumn("__hash", content_hash(text_or_empty(text_col)))
    return docs.join(again, same, "left_anti").unionByName(repeated.dropDuplicates([id_col, "__hash"]).drop("__hash"))
