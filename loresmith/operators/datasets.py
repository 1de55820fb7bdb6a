"""Checks of whole datasets and runs: each gives its violations as rows, so that a sound one gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query, table
from .contracts import assigned_split
from .graphs import components
from .shared import checked


def mission_key(sources: Column) -> Column:
    """Revision and group of a record's first source."""
    first = F.element_at(sources, 1)
    return F.concat_ws(":", first["revision"], first["source_group"])


def dataset_faults(records: DataFrame, provenance: DataFrame, missions: DataFrame) -> DataFrame:
    """(kind, name, detail) of records (id, split, mission, conversation_id, scenario_group, location), provenance (id) and configured missions (mission, split).

    Ids are unique; no mission, conversation or scenario group (null: none)
    reaches into two splits; a record's split is its mission's; provenance
    covers exactly the records.
    """
    again = records.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("location").alias("first")).where("n > 1").select(F.lit("duplicate id").alias("kind"), F.col("id").alias("name"), F.concat(F.lit("first at "), "first").alias("detail"))
    owners = records.select("split", F.explode(F.create_map(F.lit("mission"), "mission", F.lit("conversation_id"), "conversation_id", F.lit("scenario_group"), "scenario_group")).alias("kind", "name")).where("name IS NOT NULL")
    crossing = owners.groupBy("kind", "name").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1).select(F.concat("kind", F.lit(" crosses splits")).alias("kind"), "name", F.array_join("splits", ", ").alias("detail"))
    told = missions.select("mission", F.col("split").alias("told"))
    other = records.join(checked(told), "mission", "left").where(~F.col("split").eqNullSafe(F.col("told"))).select(F.lit("split differs from its mission's").alias("kind"), F.col("id").alias("name"), F.coalesce("told", F.lit("not configured")).alias("detail"))
    nothing = F.lit(None).cast("string").alias("detail")
    bare = records.join(provenance, "id", "left_anti").select(F.lit("no provenance").alias("kind"), F.col("id").alias("name"), nothing)
    orphan = provenance.join(records, "id", "left_anti").select(F.lit("provenance of no record").alias("kind"), F.col("id").alias("name"), nothing)
    return again.unionByName(crossing).unionByName(other).unionByName(bare).unionByName(orphan)


def chain_faults(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """(chain, splits) of connected missions (edges ``a, b``, which may run through missions without a split) that are not all in one split."""
    chains = components(edges).select(F.col("node").alias("mission"), "component")
    return splits.join(chains, "mission").groupBy(F.col("component").alias("chain")).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def conversation_owner_faults(users: DataFrame, splits: DataFrame) -> DataFrame:
    """Named conversations (conversation, missions) that missions of different splits use."""
    each = users.select("conversation", F.explode("missions").alias("mission")).join(splits, "mission")
    return each.groupBy("conversation").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def run_faults(selected: DataFrame, prompts: DataFrame, responses: DataFrame, pools: DataFrame | None = None) -> DataFrame:
    """(sample_id, fault) of a generation run: each response answers the prompt of its sample, word for word, each sample was asked for once, and each prompt was made of the pool (sample_id, pool_sha256) that the dataset has for it."""
    once = lambda df, name, *columns: df.groupBy("sample_id").agg(F.count(F.lit(1)).alias(name), *(F.first(c).alias(c) for c in columns))
    p = once(prompts.withColumnRenamed("messages_sha256", "asked"), "prompted", "asked", *(["pool_sha256"] if pools is not None else []))
    r = once(responses.withColumnRenamed("messages_sha256", "answered"), "responded", "status", "answered")
    joined = once(selected, "wanted").join(p, "sample_id", "full").join(r, "sample_id", "full")
    fault = (
        F.when(F.col("wanted").isNull(), "not selected").when((F.col("wanted") > 1) | (F.col("prompted") > 1) | (F.col("responded") > 1), "more than once").when(F.col("asked").isNull() & F.col("answered").isNotNull(), "response without prompt")
        .when(F.col("asked") != F.col("answered"), "prompt differs").when(~F.coalesce(F.col("status").isin("ok", "failed"), F.lit(True)), "status")
    )
    if pools is not None:
        joined = joined.join(pools.select("sample_id", F.col("pool_sha256").alias("made_of")), "sample_id", "left")
        fault = fault.when(F.col("asked").isNotNull() & F.col("made_of").isNull(), "no pool").when(F.col("pool_sha256") != F.col("made_of"), "pool differs")
    return joined.select("sample_id", fault.alias("fault")).where("fault IS NOT NULL")


def target_leaks(targets: DataFrame, context: DataFrame) -> DataFrame:
    """Passages (sample_id, path, line) of a sample's target that its own context holds; must be none."""
    return targets.join(context, ["sample_id", "path", "line"], "left_semi")


def settings_differences(left: dict, right: dict, frozen: tuple[str, ...]) -> list[str]:
    """The settings that two runs should share and do not."""
    return sorted(k for k in frozen if left.get(k) != right.get(k))


def repeated_groups(sheet: DataFrame) -> DataFrame:
    """Groups that a human review sheet shows more than once."""
    return sheet.groupBy("group").agg(F.count(F.lit(1)).alias("trials")).where("trials > 1")


def mentions(text: Column, name: str) -> Column:
    """Whether a name stands in a text as whole words, whatever characters it holds."""
    return text.rlike(r"(?U)(?<!\w)" + "".join(f"\\{c}" if not c.isalnum() and ord(c) < 128 and c != "_" else c for c in name) + r"(?!\w)")


_SPLIT = "CASE WHEN ('0x' || left(sha256(p::VARCHAR), 8))::BIGINT % 10 < 8 THEN 'train' WHEN ('0x' || left(sha256(p::VARCHAR), 8))::BIGINT % 10 = 8 THEN 'validation' ELSE 'test' END"


@query()
def chain_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains over links from every mission that are not all in one split; held to a union-find in the tests, since recursion in SQL is too slow on long chains."""
    p = F.col("p_partkey")
    edges = table(spark, sf_dir, "part").select(p.alias("a"), (p + 7).alias("b"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("mission")).distinct()
    splits = nodes.where("mission % 3 > 0").select("mission", assigned_split(F.col("mission").cast("string")).alias("split"))
    return chain_faults(edges, splits).select("chain", F.size("splits").cast("long").alias("splits"))


@query(r"""SELECT n.name, count(*) AS documents FROM (SELECT unnest(['the', 'de', 'der', 'que', 'est']) AS name) n JOIN documents d ON regexp_matches(d.text, '(^|[^\pL\pN_])' || n.name || '($|[^\pL\pN_])') GROUP BY n.name""")
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that a text names as whole words; the names are a stated list, so each text is read once."""
    docs = table(spark, sf_dir, "documents")
    found = F.array_compact(F.array(*(F.when(mentions(F.col("text"), n), n) for n in ("the", "de", "der", "que", "est"))))
    return docs.select(F.explode(found).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("documents"))


@query("""SELECT l_orderkey AS sample_id, count(*) AS leaks FROM lineitem t WHERE t.l_returnflag = 'A' AND EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = t.l_orderkey AND c.l_partkey = t.l_partkey AND c.l_returnflag = 'R')
    GROUP BY l_orderkey""")
def target_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target passages that stand in their own sample's context, by place."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.lit("p").alias("path"), F.col("l_partkey").alias("line"), "l_returnflag")
    leaks = target_leaks(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"))
    return leaks.groupBy("sample_id").agg(F.count(F.lit(1)).alias("leaks"))


@query("""WITH p AS (SELECT doc_id, sha256(text) AS asked FROM documents WHERE doc_id % 10 < 8), r AS (SELECT doc_id, sha256(CASE WHEN doc_id % 50 = 0 THEN text || '!' ELSE text END) AS answered FROM documents WHERE doc_id % 10 > 1 OR doc_id % 50 = 0)
    SELECT coalesce(p.doc_id, r.doc_id) AS sample_id, CASE WHEN coalesce(p.doc_id, r.doc_id) % 100 = 7 THEN 'not selected' WHEN p.doc_id IS NULL THEN 'response without prompt' ELSE 'prompt differs' END AS fault
    FROM p FULL JOIN r ON p.doc_id = r.doc_id WHERE coalesce(p.doc_id, r.doc_id) % 100 = 7 OR (p.doc_id IS NULL AND r.doc_id IS NOT NULL) OR p.asked <> r.answered""")
def run_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that do not answer the prompt of a selected sample; only digests move."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    prompts = docs.where(d % 10 < 8).select(d.alias("sample_id"), F.sha2("text", 256).alias("messages_sha256"))
    answered = F.when(d % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    responses = docs.where((d % 10 > 1) | (d % 50 == 0)).select(d.alias("sample_id"), F.sha2(answered, 256).alias("messages_sha256"), F.lit("ok").alias("status"))
    return run_faults(docs.where(d % 100 != 7).select(d.alias("sample_id")), prompts, responses)
