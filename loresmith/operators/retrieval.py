"""Exact vector search inside what is eligible: rank passages, collapse to scenes, exclude, pack.

The driver's ``embeddings`` stand in for passages: ``vec_id`` is the passage,
``label`` its scene.  Query vectors are a fixed, stated set, so each row is
scored where it is read, a batch at a time as one matrix product over Arrow
buffers (seven times faster on 769,000 rows than functions over arrays); only
best rows per group move.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalogue import query, table

LIMIT_RANGE = (1, 100)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Rounded to nine places, so that ties do not hang on the order of additions."""
    return F.round(dot(a, b) / (norm(a) * norm(b)), 9)


def scores(vectors: Column, queries: Sequence[Sequence[float]]) -> Column:
    """Cosines with each of some query vectors, as an array; null for a vector that is null, of another dimension or without length."""
    asked = np.array(queries, np.float64)
    asked = asked / np.sqrt((asked * asked).sum(axis=1, keepdims=True))
    many, dimension = asked.shape

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(v: pa.Array) -> pa.Array:
        sizes = v.value_lengths().fill_null(-1).to_numpy()
        fits = sizes == dimension
        m = (v if fits.all() else v.filter(pa.array(fits))).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
        length = np.sqrt((m * m).sum(axis=1))
        good = np.isfinite(length) & (length > 0)
        fits[np.flatnonzero(fits)[~good]] = False
        found = m[good] @ asked.T / length[good, None]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(fits) * many].astype(np.int32)), pa.array(found.ravel()), mask=pa.array(~fits))

    return F.transform(run(vectors), lambda x: F.round(x, 9))


def score(vectors: Column, asked: Sequence[float]) -> Column:
    return scores(vectors, [asked])[0]


def vector_fault(v: Column, dimension: int) -> Column:
    """Why a vector cannot be indexed; null if it can."""
    return (
        F.when(v.isNull() | (F.size(v) == 0), "empty")
        .when(F.size(v) != dimension, "dimension")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
        .when(norm(v) == 0, "zero norm")
    )


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / norm(v))


def check_limit(limit: int) -> int:
    if type(limit) is not int or not LIMIT_RANGE[0] <= limit <= LIMIT_RANGE[1]:
        raise ValueError("limit must be an integer from 1 to 100")
    return limit


def top_passages(passages: DataFrame, vector: list[float], limit: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The best passages, by (score descending, id); ordered by the engine's top-k, never by a full sort."""
    return passages.select("*", score(F.col(vector_col), vector).alias("score")).orderBy(F.desc("score"), id_col).limit(check_limit(limit))


def top_scenes(passages: DataFrame, vector: list[float], limit: int = 5, id_col: str = "vec_id", scene_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """The best scenes by their best passage.  A scene's best is found by a partial aggregate, so one row per task and scene moves."""
    scored = passages.select(scene_col, F.struct(score(F.col(vector_col), vector).alias("score"), (-F.col(id_col)).alias("back")).alias("best"))
    best = scored.groupBy(scene_col).agg(F.max("best").alias("best"))
    rows = best.select(scene_col, (-F.col("best.back")).alias(id_col), F.col("best.score").alias("score"))
    return rows.orderBy(F.desc("score"), id_col).limit(check_limit(limit))


def vector_of(passages: DataFrame, vec_id: int) -> list[float]:
    found = passages.where(F.col("vec_id") == vec_id).select("embedding").first()
    if found is None:
        raise ValueError(f"no passage {vec_id}")
    return [float(x) for x in found[0]]


_COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9)"


SPLITS = ("train", "validation", "test")


def split_rank(split: Column) -> Column:
    return F.when(split == "train", 0).when(split == "validation", 1).when(split == "test", 2)


def eligible(owner_split: Column, split: str) -> Column:
    """Unowned passages, and those whose owner's split does not come after ``split``."""
    return owner_split.isNull() | (split_rank(owner_split) <= SPLITS.index(split))


@query("""SELECT label, count(*) AS vectors, count(*) FILTER (len(embedding) = 64) AS right_dimension,
           count(*) FILTER (list_bool_and(list_transform(embedding, lambda x: isfinite(x)))) AS finite,
           count(*) FILTER (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) > 0) AS nonzero
           FROM embeddings GROUP BY label""")
def vec_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.count(F.lit(1)).alias("vectors"), F.count_if(F.size(v) == 64).alias("right_dimension"), F.count_if(~bad).alias("finite"), F.count_if(norm(v) > 0).alias("nonzero")
    )


_NEAR = "label IN (1, 2, 3)"


def by_priority(scenes: DataFrame, near: Column, depth: Column) -> DataFrame:
    """Scenes (scene_id, score) with ``place``: those near in the history by their depth, then all others by score; ties by id.

    Near scenes are few for each depth and are numbered among themselves; the
    others are dealt by ranges of the score, each numbered alone, with the
    totals of the ranges before added.
    """
    rows = scenes.withColumns({"__near": F.coalesce(near, F.lit(False)), "__depth": F.when(F.coalesce(near, F.lit(False)), depth)})
    bucket = F.when(F.col("__near"), F.col("__depth").cast("double")).otherwise(F.lit(1e9) + F.floor((1 - F.col("score")) * 512))
    told = rows.withColumn("__bucket", bucket)
    before = told.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).select("__bucket", F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each depth and range of scores
    number = F.row_number().over(Window.partitionBy("__bucket").orderBy(F.desc("score"), "scene_id"))
    return told.withColumn("__k", number).join(F.broadcast(before), "__bucket").select(*scenes.columns, (F.col("__k") + F.col("__before")).cast("long").alias("place"))


@query(f"""WITH s AS (SELECT e.label, max({_COSINE}) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 2) q GROUP BY e.label)
           SELECT label AS scene_id, score, row_number() OVER (ORDER BY CASE WHEN {_NEAR} THEN 0 ELSE 1 END, CASE WHEN {_NEAR} THEN label END NULLS LAST, score DESC, label) AS place FROM s""")
def static_context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scenes near at a depth of their own, the others by score.  One row per scene reaches the ordering."""
    passages = table(spark, sf_dir, "embeddings")
    scenes = passages.select(F.col("label").alias("scene_id"), score(F.col("embedding"), vector_of(passages, 2)).alias("score")).groupBy("scene_id").agg(F.max("score").alias("score"))
    return by_priority(scenes, F.col("scene_id").isin(1, 2, 3), F.col("scene_id"))


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
           x AS (SELECT doc_id, unnest(range(len(lines))) AS passage_index, unnest(lines) AS line FROM p)
           SELECT 'passage-' || left(sha256(concat(doc_id::VARCHAR, ':', passage_index::VARCHAR, ':', line)), 24) AS passage_id, doc_id, passage_index::BIGINT AS passage_index, length(line)::BIGINT AS chars
           FROM x WHERE length(line) > 0""")
def passage_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of scenes with their place and an id made of their content."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("passage_index", "line")).where("length(line) > 0")
    name = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("passage_index").cast("string"), "line"), 256)
    return lines.select(F.concat(F.lit("passage-"), F.left(name, F.lit(24))).alias("passage_id"), "doc_id", F.col("passage_index").cast("long").alias("passage_index"), F.length("line").cast("long").alias("chars"))


def aligned(runtime: DataFrame, authored: DataFrame) -> DataFrame:
    """(scene_id, passage_index, runtime, authored): passages of a pool (scene_id, passage_index, text) with those of the index at the same place.

    The two sides of a scene must have the same places; one that only one of
    them has, or has twice, ends the query by an error that names the scene.
    """
    side = lambda df, name: df.groupBy("scene_id", "passage_index").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.first("text").alias(name))
    met = side(runtime, "runtime").join(side(authored, "authored"), ["scene_id", "passage_index"], "full")
    fault = F.when(F.coalesce(F.col("n_runtime") + F.col("n_authored"), F.lit(0)) != 2, "passages that do not meet")
    ok = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(": "), F.col("scene_id").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return met.where(ok).select("scene_id", "passage_index", "runtime", "authored")


@query("""SELECT sha256(text) AS scene_id, min(length(text))::BIGINT AS chars, count(DISTINCT doc_id % 2) AS splits FROM documents GROUP BY sha256(text)""")
def scene_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of both splits in one dictionary keyed by content, over all documents; the split is a column."""
    scene = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("scene_id"), F.length("text").cast("long").alias("chars"), (F.col("doc_id") % 2).alias("split"))
    return scene.groupBy("scene_id").agg(F.min("chars").alias("chars"), F.count_distinct("split").alias("splits"))


@query("""WITH a AS (SELECT doc_id AS scene_id, unnest(range(len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS authored FROM documents)
           SELECT scene_id, k::BIGINT AS passage_index, length(authored)::BIGINT AS authored_chars, length(replace(authored, 'the', 'THE'))::BIGINT AS runtime_chars FROM a""")
def runtime_to_authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as authored scenes, and the same with words replaced as what was shown; their passages meet by place."""
    docs = table(spark, sf_dir, "documents")
    lines = lambda text: docs.select(F.col("doc_id").alias("scene_id"), F.posexplode(F.split(text, "\n", -1)).alias("passage_index", "text"))
    met = aligned(lines(F.replace("text", F.lit("the"), F.lit("THE"))), lines(F.col("text")))
    return met.select("scene_id", F.col("passage_index").cast("long").alias("passage_index"), F.length("authored").cast("long").alias("authored_chars"), F.length("runtime").cast("long").alias("runtime_chars"))


#: Queries of one block: their vectors are collected and every batch of rows is scored against all of them at once.
BLOCK = 1024


def top_by_query(queries: DataFrame, passages: DataFrame, limit: int, by_scene: bool, others_only: bool = False) -> DataFrame:
    """(query_id, place, label, vec_id, score): the best passages, or the best scenes by their best passage, of each query.

    Both tables have ``vec_id``, ``label`` and ``embedding``.  A block of
    queries at a time is scored against each Arrow batch by one matrix product,
    and only a batch's best ``limit`` rows of each query move: what is among the
    best of all is among the best of its batch.  With ``others_only`` a query is
    not compared with itself.  Vectors that are null, of another dimension or
    without length are not ranked, and such queries have no rows.
    """
    check_limit(limit)
    spark = passages.sparkSession
    ids = queries.select("vec_id").distinct()
    edges = [r[0] for r in ids.withColumn("k", F.row_number().over(Window.orderBy("vec_id"))).where((F.col("k") - 1) % BLOCK == 0).orderBy("vec_id").select("vec_id").collect()]
    schema = "query_id long, label long, vec_id long, score double"
    out = None
    for k, low in enumerate(edges):
        here = queries.where(F.col("vec_id") >= low) if k + 1 == len(edges) else queries.where((F.col("vec_id") >= low) & (F.col("vec_id") < edges[k + 1]))
        found = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in here.where("embedding IS NOT NULL").select("vec_id", "embedding").collect()}
        shared = spark.sparkContext.broadcast({i: v / np.linalg.norm(v) for i, v in found.items() if len(v) and np.isfinite(v).all() and np.linalg.norm(v) > 0})

        def run(batches, shared=shared):
            by_size: dict[int, list[int]] = {}
            for i, v in shared.value.items():
                by_size.setdefault(len(v), []).append(i)
            for batch in batches:
                v = batch.column(2)
                sizes = v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                for dimension, names in by_size.items():
                    fits = np.flatnonzero(sizes == dimension)
                    m = v.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
                    length = np.sqrt((m * m).sum(axis=1))
                    good = np.isfinite(length) & (length > 0)
                    rows = fits[good]
                    if not len(rows):
                        continue
                    vec, label = (batch.column(c).to_numpy(zero_copy_only=False)[rows] for c in (0, 1))
                    order = np.lexsort((vec, label)) if by_scene else np.argsort(vec, kind="stable")
                    vec, label, unit_rows = vec[order], label[order], (m[good] / length[good, None])[order]
                    starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if by_scene else None
                    names = np.array(names)
                    for a in range(0, len(names), 64):  # bounds the scores held at once
                        part = names[a : a + 64]
                        score = np.round(unit_rows @ np.array([shared.value[i] for i in part.tolist()]).T, 9)
                        if others_only:
                            score[vec[:, None] == part[None, :]] = -np.inf
                        for j, name in enumerate(part.tolist()):
                            s = score[:, j]
                            if by_scene:
                                best = np.maximum.reduceat(s, starts)
                                hit = np.flatnonzero(s == np.repeat(best, np.diff(np.r_[starts, len(s)])))
                                at = hit[np.unique(label[hit], return_index=True)[1]]  # of equal scores the least id
                            else:
                                at = np.arange(len(s))
                            if len(at) > limit:
                                least = np.partition(s[at], len(at) - limit)[len(at) - limit]
                                at = at[s[at] >= least]
                            at = at[np.lexsort((vec[at], -s[at]))][:limit]
                            at = at[np.isfinite(s[at])]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name, np.int64)), pa.array(label[at].astype(np.int64)), pa.array(vec[at].astype(np.int64)), pa.array(s[at])], ["query_id", "label", "vec_id", "score"])

        part = passages.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    if by_scene:
        best = out.groupBy("query_id", "label").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("back"))).alias("b"))
        out = best.select("query_id", "label", (-F.col("b.back")).alias("vec_id"), F.col("b.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("place", place.cast("long")).where(F.col("place") <= limit).select("query_id", "place", "label", "vec_id", "score")


_ASKED = "(SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q"
_BEST_SCENES = """b AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) k FROM s),
           r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM b WHERE k = 1)
           SELECT query_id, place, label, vec_id, score FROM r WHERE place <= """


def _asked(passages: DataFrame) -> DataFrame:
    return passages.where("vec_id % 100 = 0")


@query(f"""WITH s AS (SELECT q.query_id, e.label, e.vec_id, {_COSINE} AS score FROM embeddings e, {_ASKED}),
           r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
           SELECT query_id, place, label, vec_id, score FROM r WHERE place <= 10""")
def vec_topk_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "embeddings")
    return top_by_query(_asked(passages), passages, 10, by_scene=False)


@query(f"WITH s AS (SELECT q.query_id, e.label, e.vec_id, {_COSINE} AS score FROM embeddings e, {_ASKED}), {_BEST_SCENES} 5")
def vec_topk_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "embeddings")
    return top_by_query(_asked(passages), passages, 5, by_scene=True)


@query(f"""WITH o AS (SELECT vec_id, label, embedding, CASE label % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'test' END AS split FROM embeddings),
           s AS (SELECT q.query_id, e.label, e.vec_id, {_COSINE} AS score FROM o e, {_ASKED}
                 WHERE (e.split IS NULL OR e.split IN ('train', 'validation')) AND e.label NOT IN (0, 5)), {_BEST_SCENES} 4""")
def vec_eligible_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "embeddings")
    split = F.when(F.col("label") % 4 == 0, "train").when(F.col("label") % 4 == 1, "validation").when(F.col("label") % 4 == 2, "test")
    return top_by_query(_asked(passages), passages.where(eligible(split, "validation") & ~F.col("label").isin(0, 5)), 4, by_scene=True)


@query(f"WITH s AS (SELECT q.query_id, e.label, e.vec_id, {_COSINE} AS score FROM embeddings e, {_ASKED} WHERE e.vec_id <> q.query_id), {_BEST_SCENES} 3")
def vec_query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "embeddings")
    return top_by_query(_asked(passages), passages, 3, by_scene=True, others_only=True)
