"""Selections that hang on hashes or order: seeds, picks, blinding, limits, and packing into a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query, table


def seeded_key(seed: str, *parts: Column) -> Column:
    """A hash that orders or picks the same way in every run."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts)), 256)


def sample_seed(seed: int, name: Column) -> Column:
    """The first eight hex digits of a hash as a number."""
    return F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), F.lit(8)), 16, 10).cast("long")


@query("""SELECT n_regionkey AS mission, arg_min(n_name, sha256(concat('context:', n_regionkey, ':', n_name))) AS picked FROM nation GROUP BY n_regionkey""")
def seeded_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each mission, by the least hash: the same whatever order candidates come in."""
    key = seeded_key("context", F.col("n_regionkey"), F.col("n_name"))
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("mission")).agg(F.min_by("n_name", key).alias("picked"))


@query("""SELECT doc_id, ('0x' || left(sha256(concat('42:', doc_id::VARCHAR)), 8))::BIGINT AS seed FROM documents""")
def sample_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sample_seed(42, F.col("doc_id").cast("string")).alias("seed"))


@query("""SELECT quality, toxic, count(*) AS trials, abs(count(*) FILTER (k % 2 = 0) - count(*) FILTER (k % 2 = 1)) <= 1 AS balanced FROM
    (SELECT quality, toxic, row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256(concat('blind:', doc_id::VARCHAR)), doc_id) AS k FROM labels) GROUP BY quality, toxic""")
def blinding_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = balanced_sides(table(spark, sf_dir, "labels"), ["quality", "toxic"])
    a, b = F.count_if(F.col("side") == "A"), F.count_if(F.col("side") == "B")
    return sides.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("trials"), (F.abs(a - b) <= 1).alias("balanced"))


#: Parts into which the trials of one condition are dealt before they are numbered.
PARTS = 64


def balanced_sides(trials: DataFrame, keys: list[str], id_col: str = "doc_id", seed: str = "blind") -> DataFrame:
    """Sides A and B in turn down the order of a hash, so that no condition has more than one more of either.

    A condition may hold most of the trials, so its hashes are dealt by their
    first digits: each part is numbered alone, and the numbers of the parts
    before it (a row per condition and part) are added.
    """
    key = seeded_key(seed, F.col(id_col))
    rows = trials.select(*keys, id_col, key.alias("__key"), F.floor(F.conv(F.left(key, F.lit(2)), 16, 10).cast("int") * PARTS / 256).alias("__part"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n")).select(*keys, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__key", id_col))
    same = [rows[k].eqNullSafe(counts[k]) for k in keys]
    joined = rows.withColumn("__k", number).alias("r").join(counts.alias("c"), [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys] + [F.col("r.__part") == F.col("c.__part")]) if same else rows
    return joined.select(*(F.col(f"r.{k}") for k in keys), F.col(f"r.{id_col}"), F.when((F.col("r.__k") + F.col("c.__before")) % 2 == 1, "A").otherwise("B").alias("side"))


@query("""SELECT label AS query, CASE WHEN ('0x' || right(sha256(concat('pair:', label::VARCHAR)), 1))::INT % 2 = 0 THEN 'small' ELSE 'large' END AS first_run, count(*) AS passages FROM embeddings GROUP BY label""")
def parity_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two runs is shown first hangs on the last digit of a hash of the query."""
    odd = F.conv(F.right(F.sha2(F.concat(F.lit("pair:"), F.col("label").cast("string")), 256), F.lit(1)), 16, 10).cast("int") % 2
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("query"), F.when(odd == 0, "small").otherwise("large").alias("first_run")).agg(F.count(F.lit(1)).alias("passages"))


def selected(samples: DataFrame, ids: Sequence, id_col: str, limit: int | None = None) -> DataFrame:
    """The samples of a stated list of ids in its order, with their ``place`` from 0; then the first ``limit`` of them.

    An id that is not there, or is listed or found twice, is refused.  The list is
    the caller's, so it is small; the samples are read once, by a filter.
    """
    if len(set(ids)) != len(ids):
        raise ValueError("an id is listed twice")
    if not ids:
        return samples.where(F.lit(False)).withColumn("place", F.lit(0))
    kind = samples.schema[id_col].dataType
    places = F.create_map(*(x for i, n in enumerate(ids) for x in (F.lit(n).cast(kind), F.lit(i))))
    found = samples.where(F.col(id_col).isin(list(ids))).withColumn("place", places[F.col(id_col)])
    counts = {r[id_col]: r["n"] for r in found.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the list
    if bad := [x for x in ids if counts.get(x) != 1]:
        raise ValueError(f"samples that are not there once: {bad}")
    ordered = found.orderBy("place")
    return ordered if limit is None else ordered.limit(limit)


@query("""SELECT d.doc_id, p.place FROM (SELECT unnest([9, 3, 7, 1, 5]) AS doc_id, unnest([0, 1, 2, 3, 4]) AS place) p JOIN documents d ON d.doc_id = p.doc_id ORDER BY place LIMIT 3""")
def sample_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated list of ids in its order, then the first of them: the list and the limit are the feature."""
    return selected(table(spark, sf_dir, "documents").select("doc_id"), [9, 3, 7, 1, 5], "doc_id", 3)


def shuffled(rows: DataFrame, id_col: str, seed: str = "shuffle") -> DataFrame:
    """All rows in one order that hangs on a hash alone, numbered from 0 as ``place``.

    Rows are dealt by ranges of the hash and numbered range by range (one total
    for each of ``PARTS`` ranges), so no task sorts them all.
    """
    key = seeded_key(seed, F.col(id_col))
    told = rows.withColumns({"__key": key, "__part": F.floor(F.conv(F.left(key, F.lit(2)), 16, 10).cast("int") * PARTS / 256)})
    counts = told.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # PARTS rows
    number = F.row_number().over(Window.partitionBy("__part").orderBy("__key", id_col))
    return told.withColumn("__k", number).join(F.broadcast(before), "__part").select(*rows.columns, (F.col("__k") + F.col("__before") - 1).cast("long").alias("place"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY sha256(concat('shuffle:', doc_id::VARCHAR)), doc_id) - 1 AS place FROM documents""")
def shuffled_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""SELECT lang, arg_max(doc_id, n_chars * 1000000000 - doc_id) AS doc_id, max(n_chars) AS chars FROM documents GROUP BY lang""")
def longest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest sample of each kind; of equals the first."""
    rows = table(spark, sf_dir, "documents").groupBy("lang")
    return rows.agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("chars"))


@query("""SELECT lang, source, arg_min(doc_id, sha256(concat('0:', doc_id::VARCHAR))) AS kept, count(*) AS routes FROM documents GROUP BY lang, source""")
def bounded_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One route for each projected state, by the least digest; more states than the limit would be an error, nothing is cut."""
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min_by("doc_id", seeded_key("0", F.col("doc_id"))).alias("kept"), F.count(F.lit(1)).alias("routes"))
    return rows


def greedy_pack(items: DataFrame, group_col: str, order_cols: list[str], cost_col: str, id_col: str, budget: int) -> DataFrame:
    """(group, used, ids): items taken in order whenever they still fit; one that does not is passed over and the next is tried.

    Of the items of one cost the ones taken are the first few, at most
    budget / cost: once one of them does not fit, no later one does.  So only
    that many of each (group, cost) are gathered, however many the group has,
    and the fold over them is exact and bounded by the budget alone.  Items that
    cost nothing always fit: they are listed without a fold.  Every group is
    returned, with 0 and no ids where nothing fits; a null cost never fits, a
    cost below 0 is refused.
    """
    cost = F.col(cost_col).cast("long")
    entry = F.struct(*order_cols, cost.alias("cost"), F.col(id_col).alias("name"))
    place = F.row_number().over(Window.partitionBy(group_col, cost_col).orderBy(*order_cols))
    kept = items.where((F.col(cost_col) >= 1) & (F.col(cost_col) <= budget)).select(group_col, entry.alias("x"), place.alias("k")).where(F.col("k") <= F.floor(F.lit(budget) / F.col("x.cost")))
    listed = kept.groupBy(group_col).agg(F.array_sort(F.collect_list("x")).alias("items"))
    kind = items.schema[id_col].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.slice("items", 1, 0).alias("taken"))
    folded = F.aggregate("items", start, lambda s, x: F.when(s["used"] + x["cost"] <= budget, F.struct((s["used"] + x["cost"]).alias("used"), F.array_append(s["taken"], x).alias("taken"))).otherwise(s))
    packed = listed.select(group_col, folded.alias("f"))
    refused = F.max(F.when(cost < 0, F.raise_error(F.lit("a cost below 0")).cast("long")))
    groups = items.groupBy(group_col).agg(F.collect_list(F.when(cost == 0, entry)).alias("free"), refused.alias("none"))
    joined = groups.alias("g").join(packed.alias("p"), F.col(f"g.{group_col}").eqNullSafe(F.col(f"p.{group_col}")), "left")
    both = F.when(F.col("p.f").isNull(), F.col("g.free")).otherwise(F.concat("p.f.taken", "g.free"))
    ids = F.transform(F.array_sort(both), lambda x: x["name"]).cast(f"array<{kind}>")
    return joined.where("g.none IS NULL").select(F.col(f"g.{group_col}").alias(group_col), F.coalesce("p.f.used", F.lit(0)).alias("used"), ids.alias("ids"))


@query("""WITH RECURSIVE r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
    w AS (SELECT source, k, CASE WHEN n_chars <= 8192 THEN n_chars ELSE 0 END AS used, CASE WHEN n_chars <= 8192 THEN [doc_id] ELSE []::BIGINT[] END AS ids FROM r WHERE k = 1
      UNION ALL SELECT r.source, r.k, CASE WHEN w.used + r.n_chars <= 8192 THEN w.used + r.n_chars ELSE w.used END, CASE WHEN w.used + r.n_chars <= 8192 THEN list_append(w.ids, r.doc_id) ELSE w.ids END
      FROM w JOIN r ON r.source = w.source AND r.k = w.k + 1)
    SELECT source, arg_max(used, k)::BIGINT AS used, arg_max(ids, k) AS ids FROM w GROUP BY source""")
def greedy_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_pack(table(spark, sf_dir, "documents"), "source", ["doc_id"], "n_chars", "doc_id", 8192)


@query("""SELECT conv_id, list(turn ORDER BY turn) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def source_order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected blocks stand in source order, whatever order they were selected in."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return rows.agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.sum(F.length("text")).alias("chars"))
