"""Prompts: tasks, cues, overviews, rendered pools, and whole scenes packed into what a prompt may hold."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalogue import query, table
from ..functions.text import fingerprint

# The wording of tasks, headings and labels in prompts.
INSTRUCTIONS = {
    "scene_continuation": "Continue the scene with the next passage, keeping the characters and events authentic to the supplied context.",
    "scene_opening": "Write the opening passage of a scene, keeping the characters and events authentic to the supplied context.",
}
EARLIER, OTHERS = "\n\nEarlier passages:\n", "\n\nOther game scenes (independent writing references):\n"
PREREQUISITES = "Mission prerequisites (OR means at least one producer, possibly several):\n"
NO_PREREQUISITES, EARLIER_SCENES, NO_SCENES = "No prerequisite missions.", "\nEarlier scenes in this interpreted history (oldest first):\n", "No earlier scenes."

#: Token counts of texts, many at a time.
Count = Callable[[Sequence[str]], Sequence[int]]


def tokenizer_counter(path: str) -> Count:
    """A counter by a tokenizer file, loaded once in each worker."""
    held: list = []

    def count(texts: Sequence[str]) -> list[int]:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        return [len(x.ids) for x in held[0].encode_batch(list(texts), add_special_tokens=False)]

    return count


def token_counts(text: Column, count: Count) -> Column:
    """The number of tokens of each text, by Arrow batches; null has none."""

    @F.pandas_udf(T.LongType())
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(count(texts.fillna("").tolist()), dtype="int64")

    return counted(text)


def block_text(heading: Column, phase: Column, passages: Column) -> Column:
    """A scene: heading with its phase where there is one, then passages (text, role) apart by an empty line, choices marked."""
    shown = F.transform(passages, lambda p: F.concat(F.when(p["role"] == "option", "Player choice: ").otherwise(""), p["text"]))
    return F.concat(heading, F.when(phase.isNotNull(), F.concat(F.lit(" — on "), phase)).otherwise(""), F.lit("\n"), F.array_join(shown, "\n\n"))


def scene_task(has_prefix: Column) -> Column:
    return F.when(has_prefix, "scene_continuation").otherwise("scene_opening")


def instruction(task: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in INSTRUCTIONS.items() for x in pair))[task]


def character_reference(description: Column) -> Column:
    """Who a character is, without a speaking role for the model."""
    return F.concat(F.lit("Character reference: "), F.regexp_replace(description, "^You are ", ""))


def cue(mission: Column, phase: Column, values: Column, system_of: Column, entered: Column) -> Column:
    """Where a scene stands: mission and phase, the place (of origin up to acceptance, then of the goal; on entering, the system entered), and the mission's values by name.

    ``values`` is a map from markers like ``<planet>``, ``system_of`` one from
    planets to systems; what is null or absent is not told.
    """
    place = F.when(phase.isin("offer", "accept"), values["<origin>"]).otherwise(values["<planet>"])
    at = F.concat(F.lit(" Current location: "), place, F.lit("."), F.coalesce(F.concat(F.lit(" System: "), system_of[place], F.lit(".")), F.lit("")))
    where = F.when(phase == "enter", F.concat(F.lit(" Current system: "), entered, F.lit("."))).otherwise(at)
    listed = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(F.substr(e["key"], F.lit(2), F.length(e["key"]) - 2), F.lit(": "), e["value"]))
    told = F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.concat(F.lit("\nMission values:\n"), F.array_join(listed, "\n"))).otherwise("")
    return F.concat(F.lit("Current mission: "), mission, F.lit(". Scene: on "), phase, F.lit("."), F.coalesce(where, F.lit("")), told)


def overview(links: Column, scenes: Column) -> Column:
    """What a mission hangs on and what came before it: ``links`` (producers: array of (parent, phase); mission) and ``scenes`` (mission, phase, scene_id), both in order."""
    link = lambda x: F.concat(F.array_join(F.transform(x["producers"], lambda p: F.concat(p["parent"], F.lit(" (on "), p["phase"], F.lit(")"))), " OR "), F.lit(" -> "), x["mission"])
    scene = lambda s: F.concat_ws(" | ", s["mission"], F.concat(F.lit("on "), s["phase"]), s["scene_id"])
    listed = lambda c, f, none: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(F.transform(c, f), "\n")).otherwise(none)
    return F.concat(F.lit(PREREQUISITES), listed(links, link, NO_PREREQUISITES), F.lit(EARLIER_SCENES), listed(scenes, scene, NO_SCENES))


def system_text(prefix: Column, history: Column, references: Column) -> Column:
    """A pool's system message: its prefix, then the scenes of the history and the independent references, each under its label if there is any."""
    section = lambda label, texts: F.when(F.size(texts) > 0, F.concat(F.lit(label), F.array_join(texts, "\n\n"))).otherwise("")
    return F.concat(prefix, section(EARLIER, history), section(OTHERS, references))


def pool_prompts(pools: DataFrame, scenes: DataFrame) -> DataFrame:
    """(sample_id, ``system``) of pools (sample_id, system_prefix) with their scenes (sample_id, kind, place, text) in the order of places; a pool without scenes has its prefix."""
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "text")))), lambda x: x["text"])
    by = scenes.groupBy("sample_id").agg(listed("history").alias("history"), listed("reference").alias("references"))
    none = F.array().cast("array<string>")
    return pools.join(by, "sample_id", "left").select("sample_id", system_text(F.col("system_prefix"), F.coalesce("history", none), F.coalesce("references", none)).alias("system"))


def rendered(prefix: str, scenes: Sequence[tuple[str, int, str]]) -> str:
    """The same of one pool, from (kind, place, text)."""
    part = lambda label, kind: label + "\n\n".join(t for k, _, t in sorted(scenes, key=lambda s: s[1]) if k == kind) if any(k == kind for k, *_ in scenes) else ""
    return prefix + part(EARLIER, "history") + part(OTHERS, "reference")


def packed_prompts(pools: DataFrame, ranked: DataFrame, count: Count, budget: int) -> DataFrame:
    """(sample_id, system, scene_ids, input_tokens): whole scenes taken in the order of ``rank`` whenever the WHOLE rendered prompt still fits; what does not fit is passed over.

    ``pools``: sample_id, system_prefix, encounter; ``ranked``: sample_id,
    scene_id, kind, place, rank, text.  The prompt with nothing but prefix and
    encounter must fit, else an error names the sample.  A sample's scenes are
    read by one task, sample by sample.
    """

    def pack(key: tuple, own: pd.DataFrame, scenes: pd.DataFrame) -> pd.DataFrame:
        out = []
        for pool in own.itertuples():
            size = lambda taken, pool=pool: int(count([rendered(pool.system_prefix, taken) + (pool.encounter or "")])[0])
            taken: list[tuple[str, int, str]] = []
            names, used = [], size([])
            if used > budget:
                raise ValueError(f"instructions and encounter exceed the budget: {pool.sample_id}")
            for s in scenes.sort_values(["rank", "scene_id"]).itertuples():
                more = size([*taken, (s.kind, s.place, s.text)])
                if more <= budget:
                    taken, used = [*taken, (s.kind, s.place, s.text)], more
                    names.append(s.scene_id)
            out.append((pool.sample_id, rendered(pool.system_prefix, taken), names, used))
        return pd.DataFrame(out, columns=["sample_id", "system", "scene_ids", "input_tokens"])

    kinds = {f.name: f.dataType.simpleString() for f in (*pools.schema, *ranked.schema)}
    schema = f"sample_id {kinds['sample_id']}, system string, scene_ids array<{kinds['scene_id']}>, input_tokens long"
    return pools.groupBy("sample_id").cogroup(ranked.groupBy("sample_id")).applyInPandas(pack, schema)


@F.pandas_udf(T.StringType())
def pool_fingerprint(pool: pd.Series) -> pd.Series:
    """The fingerprint of a pool given as JSON, without the authored copies of its scenes (``source_passages``)."""

    def one(text):
        if text is None:
            return None
        held = copy.deepcopy(json.loads(text))
        for block in [*held.get("blocks", []), *held.get("references", [])]:
            block.pop("source_passages", None)
        return fingerprint(held)

    return pool.map(one)


#: What a reviewer may see of a retrieved document.
REVIEWED = ("id", "scene_id", "kind", "mission", "heading", "path", "lines", "source_kind", "depth", "usage", "passage_index", "text")


def for_review(documents: DataFrame) -> DataFrame:
    """Documents without scores or any signal of rank; of a matched passage only its id, line and index."""
    kept = [F.col(c) for c in documents.columns if c in REVIEWED]
    if "matched_passage" in documents.columns:
        kept.append(F.struct(*(F.col(f"matched_passage.{x}").alias(x) for x in ("id", "line", "passage_index"))).alias("matched_passage"))
    return documents.select(*kept)


def longest_pools(pools: DataFrame) -> DataFrame:
    """(mission, sample_id, blocks): of each mission's pools (mission, place, sample_id, blocks: how many scenes of history) that with most, of equals the first by place."""
    best = F.max_by(F.struct("sample_id", "blocks"), F.struct(F.col("blocks"), -F.col("place")))
    return pools.groupBy("mission").agg(best.alias("b")).select("mission", "b.sample_id", "b.blocks")


def comparison_counts(scenes: DataFrame) -> DataFrame:
    """One row: scenes, passages, characters and words of distinct scenes (scene_id, passages: array of text)."""
    once = scenes.dropDuplicates(["scene_id"])
    total = lambda f: F.coalesce(F.sum(F.aggregate(F.transform("passages", f), F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
    words = lambda t: F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")).cast("long")
    return once.agg(F.count(F.lit(1)).alias("scenes"), F.coalesce(F.sum(F.size("passages").cast("long")), F.lit(0)).alias("passages"), total(lambda t: F.length(t).cast("long")).alias("characters"), total(words).alias("words"))


def with_choices(samples: DataFrame, provenance: DataFrame) -> DataFrame:
    """Samples with the ``player_choices`` of their provenance, null where it tells none; the private column ``evaluation`` goes."""
    return samples.drop("evaluation").join(provenance.select("sample_id", "player_choices"), "sample_id", "left")


@query(f"""WITH t AS (SELECT conv_id, turn, role, upper(role) || ' — on turn' || chr(10) || text AS shown FROM conversations),
    h AS (SELECT conv_id, string_agg(shown, chr(10) || chr(10) ORDER BY turn) AS history FROM t WHERE role = 'user' GROUP BY conv_id),
    r AS (SELECT conv_id, string_agg(shown, chr(10) || chr(10) ORDER BY turn) AS refs FROM t WHERE role <> 'user' GROUP BY conv_id)
    SELECT c.conv_id AS sample_id, md5('Conversation ' || c.conv_id || coalesce('{EARLIER}' || history, '') || coalesce('{OTHERS}' || refs, '')) AS system
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN h ON h.conv_id = c.conv_id LEFT JOIN r ON r.conv_id = c.conv_id""")
def pool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users as the history and all others as references of a conversation's pool."""
    rows = table(spark, sf_dir, "conversations")
    passages = F.array(F.struct(F.col("text").alias("text"), F.lit("passage").alias("role")))
    scenes = rows.select(F.col("conv_id").alias("sample_id"), F.when(F.col("role") == "user", "history").otherwise("reference").alias("kind"), F.col("turn").alias("place"), block_text(F.upper("role"), F.lit("turn"), passages).alias("text"))
    pools = rows.select(F.col("conv_id").alias("sample_id"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("system_prefix")).distinct()
    return pool_prompts(pools, scenes.where("text IS NOT NULL")).select("sample_id", F.md5("system").alias("system"))


@query("""SELECT c_custkey, 'Current mission: ' || c_name || '. Scene: on ' || p.phase || '.' || CASE p.phase WHEN 'enter' THEN ' Current system: ' || r_name || '.' ELSE
      CASE WHEN p.phase = 'complete' AND c_custkey % 3 = 0 THEN '' ELSE ' Current location: ' || CASE WHEN p.phase = 'offer' THEN n_name || '. System: ' || r_name ELSE c_mktsegment END || '.' END END
      || chr(10) || 'Mission values:' || chr(10) || 'origin: ' || n_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(10) || 'planet: ' || c_mktsegment END AS cue,
    'Mission prerequisites (OR means at least one producer, possibly several):' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'No prerequisite missions.' ELSE n_name || ' (on complete) OR ' || r_name || ' (on offer) -> ' || c_name END
      || chr(10) || 'Earlier scenes in this interpreted history (oldest first):' || chr(10) || CASE WHEN c_custkey % 5 = 0 THEN 'No earlier scenes.' ELSE n_name || ' | on offer | s1' || chr(10) || r_name || ' | on visit | s2' END AS overview,
    CASE WHEN c_acctbal > 0 THEN 'scene_continuation' ELSE 'scene_opening' END AS task
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (SELECT unnest(['offer', 'enter', 'complete']) AS phase) p WHERE p.phase = ['offer', 'enter', 'complete'][(c_custkey % 3 + 1)::INT]""")
def scene_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as missions, nations as where they come from, regions as systems, segments as where they go."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 3
    phase = F.when(k == 0, "offer").when(k == 1, "enter").otherwise("complete")
    values = F.map_filter(F.create_map(F.lit("<origin>"), F.col("n_name"), F.lit("<planet>"), F.when(k != 0, F.col("c_mktsegment"))), lambda _, v: v.isNotNull())
    of = lambda a, b, c: F.struct(a.alias("mission"), F.lit(b).alias("phase"), F.lit(c).alias("scene_id"))
    link = F.struct(F.array(F.struct(F.col("n_name").alias("parent"), F.lit("complete").alias("phase")), F.struct(F.col("r_name").alias("parent"), F.lit("offer").alias("phase"))).alias("producers"), F.col("c_name").alias("mission"))
    links, scenes = F.when(F.col("c_custkey") % 2 == 1, F.array(link)), F.when(F.col("c_custkey") % 5 != 0, F.array(of(F.col("n_name"), "offer", "s1"), of(F.col("r_name"), "visit", "s2")))
    return rows.select("c_custkey", cue(F.col("c_name"), phase, values, F.create_map("n_name", "r_name"), F.col("r_name")).alias("cue"), overview(links, scenes).alias("overview"), scene_task(F.col("c_acctbal") > 0).alias("task"))


@query("""SELECT c_custkey, 'Character reference: ' || c_name AS reference FROM customer""")
def character_reference_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the names come as a description of who one is."""
    told = F.concat(F.when(F.col("c_custkey") % 2 == 0, "You are ").otherwise(""), "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", character_reference(told).alias("reference"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, count(*) AS blocks FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT o_custkey AS mission, arg_max(o_orderkey, blocks * 10000000000 - o_orderkey) AS sample_id, max(blocks) AS blocks FROM o GROUP BY o_custkey""")
def pool_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pools of their customers, lines as the scenes in them."""
    blocks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count(F.lit(1)).alias("blocks"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("mission"), F.col("o_orderkey").alias("place"))
    return longest_pools(orders.join(blocks, "sample_id"))


@query("""WITH s AS (SELECT DISTINCT text FROM documents), p AS (SELECT text, unnest(string_split(text, chr(10))) AS passage FROM s)
    SELECT (SELECT count(*) FROM s) AS scenes, count(*) AS passages, sum(length(passage))::BIGINT AS characters,
      sum(len(list_filter(regexp_split_to_array(passage, '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}]+'), lambda w: w <> '')))::BIGINT AS words FROM p""")
def comparison_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as scenes, each once, and their lines as passages."""
    return comparison_counts(table(spark, sf_dir, "documents").select(F.md5("text").alias("scene_id"), F.split("text", "\n", -1).alias("passages")))


@query("""SELECT d.doc_id AS sample_id, d.lang, CASE WHEN l.toxic = 1 THEN 'chosen ' || l.quality END AS player_choices FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def player_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "lang", F.lit("private").alias("evaluation"))
    told = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.when(F.col("toxic") == 1, F.concat(F.lit("chosen "), F.col("quality").cast("string"))).alias("player_choices"))
    return with_choices(samples, told)


@query("""SELECT vec_id AS id, label AS scene_id, 'reference' AS kind, vec_id + 1 AS line FROM embeddings""")
def review_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved passages as reviewers see them: no score, no rank."""
    found = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("scene_id"), F.lit("reference").alias("kind"), F.lit(0.5).alias("score"), F.lit(1).alias("rank"),
        F.struct(F.col("vec_id").alias("id"), (F.col("vec_id") + 1).alias("line"), F.lit(0).alias("passage_index"), F.lit(0.5).alias("score")).alias("matched_passage"),
    )
    return for_review(found).select("id", "scene_id", "kind", "matched_passage.line")


@query("""SELECT n_nationkey, sha256('{"blocks": [{"heading": "' || n_name || '", "path": null}], "references": [], "sample_id": "' || n_nationkey || '"}') AS fingerprint FROM nation""")
def pool_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools with authored copies in their blocks, which do not count."""
    told = F.format_string('{"sample_id":"%d","references":[],"blocks":[{"source_passages":[1],"path":null,"heading":"%s"}]}', "n_nationkey", "n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", pool_fingerprint(told).alias("fingerprint"))


@query("""SELECT doc_id, coalesce(sum(len(string_split(p, ' '))), 0)::BIGINT AS tokens FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY doc_id""")
def line_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter that takes parts between blanks as tokens, over all lines of all texts."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    counted = lines.select("doc_id", token_counts(F.col("line"), lambda texts: [len(t.split(" ")) for t in texts]).alias("n"))
    return counted.groupBy("doc_id").agg(F.sum("n").alias("tokens"))
