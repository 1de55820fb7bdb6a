"""Checks of records, splits, ownership and leakage; each gives its violations or labels as rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from ..catalogue import query, table
from .shared import checked

# Fixed patterns: names of records, and text that is nothing but white space.
SLUG = r"^[a-z0-9]+(?:[-_][a-z0-9]+)*\z"
BLANK = r"(?U)^\s*\z"


def turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation with its messages in turn order; a conversation's length is bounded by what one reader's record holds."""
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def conversation_fault(messages: Column) -> Column:
    """The first broken rule of a message list, else null: known roles, text that is not blank, system only first, then user and assistant in pairs."""
    known = F.forall(messages, lambda m: F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False)))
    filled = F.forall(messages, lambda m: F.coalesce(~m["text"].rlike(BLANK), F.lit(False)))
    led = F.element_at(messages, 1)["role"] == "system"
    rest = F.when(led, F.slice(messages, 2, F.size(messages))).otherwise(messages)
    placed = F.forall(rest, lambda m: m["role"] != "system")
    paired = (F.size(rest) >= 2) & (F.size(rest) % 2 == 0) & F.forall(F.transform(rest, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    return F.when(F.size(messages) == 0, "empty").when(~known, "role").when(~filled, "blank").when(~placed, "system").when(~paired, "pairs")


def conversation_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, messages, target, target_role, fault) of messages as rows, by the same rules.

    A message's place comes from a window that streams through its
    conversation, and everything else is an aggregate over the same
    partitioning: a conversation of any length is never held as a whole.
    """
    order = ("turn", "role", "text")
    window = Window.partitionBy("conv_id").orderBy(*order)
    led = F.coalesce(F.first("role").over(window.rowsBetween(Window.unboundedPreceding, 0)) == "system", F.lit(False)).cast("int")
    placed = rows.select("conv_id", *order, (F.row_number().over(window) - 1).alias("k"), led.alias("led"))
    k, role = F.col("k") - F.col("led"), F.col("role")
    found = placed.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.max_by("text", F.struct(*order)).alias("target"), F.max_by("role", F.struct(*order)).alias("target_role"),
        F.bool_and(F.coalesce(role.isin("system", "user", "assistant"), F.lit(False))).alias("known"), F.bool_and(F.coalesce(~F.col("text").rlike(BLANK), F.lit(False))).alias("filled"),
        F.bool_and((role != "system") | (F.col("k") == 0)).alias("placed"), F.bool_and((k < 0) | (role == F.when(k % 2 == 0, "user").otherwise("assistant"))).alias("paired"), F.max("led").alias("led"),
    )
    rest = F.col("messages") - F.col("led")
    fault = F.when(~F.col("known"), "role").when(~F.col("filled"), "blank").when(~F.col("placed"), "system").when((rest < 2) | (rest % 2 == 1) | ~F.col("paired"), "pairs")
    return found.select("conv_id", "messages", "target", "target_role", fault.alias("fault"))


_TURNS = "SELECT conv_id, list(role ORDER BY turn, role, text) AS roles, list(text ORDER BY turn, role, text) AS texts FROM conversations GROUP BY conv_id"
_FAULT = """CASE WHEN NOT list_bool_and(list_transform(roles, lambda r: coalesce(r IN ('system', 'user', 'assistant'), false))) THEN 'role'
    WHEN NOT list_bool_and(list_transform(texts, lambda t: coalesce(regexp_matches(t, '[^\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}]'), false))) THEN 'blank'
    WHEN list_contains(rest, 'system') THEN 'system'
    WHEN len(rest) < 2 OR len(rest) % 2 = 1 OR NOT list_bool_and(list_transform(rest, lambda r, i: r = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) THEN 'pairs' END"""
_CHECKED = f"WITH t AS ({_TURNS}), s AS (SELECT *, CASE WHEN roles[1] = 'system' THEN roles[2:] ELSE roles END AS rest FROM t), f AS (SELECT *, {_FAULT} AS fault FROM s)"


@query(f"{_CHECKED} SELECT conv_id, coalesce(fault, 'ok') AS status, len(roles)::BIGINT AS messages FROM f")
def conv_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_faults(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", F.coalesce("fault", F.lit("ok")).alias("status"), "messages")


@query(f"{_CHECKED} SELECT conv_id, (len(roles) - 1)::BIGINT AS visible, texts[-1] AS target, roles[-1] AS target_role FROM f WHERE fault IS NULL")
def conv_withhold_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a model may see of a valid record, and the withheld last message."""
    rows = conversation_faults(table(spark, sf_dir, "conversations")).where("fault IS NULL")
    return rows.select("conv_id", (F.col("messages") - 1).alias("visible"), "target", "target_role")


def visible_messages(messages: Column) -> Column:
    """The messages of a record without the last."""
    return F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))


@query("""SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Player choice: ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn, role, text) AS prompt
           FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY conv_id""")
def conv_render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as one block: the player's lines are marked, passages stand apart by an empty line."""
    rows = turns(table(spark, sf_dir, "conversations").where("role IS NOT NULL AND text IS NOT NULL"))
    return rows.select("conv_id", F.array_join(F.transform("messages", lambda m: F.when(m["role"] == "user", F.concat(F.lit("Player choice: "), m["text"])).otherwise(m["text"])), "\n\n").alias("prompt"))


def assigned_split(key: Column) -> Column:
    """A split by the hash of a key: 8 of 10 train, 1 validation, 1 test."""
    bucket = F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("long") % 10
    return F.when(bucket < 8, "train").when(bucket == 8, "validation").otherwise("test")


_SPLIT = "CASE WHEN ('0x' || left(sha256({0}), 8))::BIGINT % 10 < 8 THEN 'train' WHEN ('0x' || left(sha256({0}), 8))::BIGINT % 10 = 8 THEN 'validation' ELSE 'test' END"


@query(f"SELECT doc_id, {_SPLIT.format('doc_id::VARCHAR')} AS split FROM documents")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", assigned_split(F.col("doc_id").cast("string")).alias("split"))


@query("""SELECT left(sha256(text), 24) AS id, count(*) AS rows, min(doc_id) AS first_location FROM documents GROUP BY 1 HAVING count(*) > 1""")
def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that more than one record carries, with the first that does."""
    ids = table(spark, sf_dir, "documents").select(F.left(F.sha2("text", 256), F.lit(24)).alias("id"), "doc_id")
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first_location")).where("rows > 1")


@query(f"""WITH r AS (SELECT {_SPLIT.format('doc_id::VARCHAR')} AS split, source AS mission, sha256(text) AS conversation_id, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS scenario_group FROM documents),
           u AS (SELECT 'mission' AS kind, mission AS owner, split FROM r UNION ALL SELECT 'conversation_id', conversation_id, split FROM r UNION ALL SELECT 'scenario_group', scenario_group, split FROM r WHERE scenario_group IS NOT NULL)
           SELECT kind, owner, count(DISTINCT split) AS splits FROM u GROUP BY kind, owner HAVING count(DISTINCT split) > 1""")
def cross_split_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners (mission, conversation, scenario group) that reach into more than one split; a null group binds nothing."""
    records = table(spark, sf_dir, "documents").select(
        assigned_split(F.col("doc_id").cast("string")).alias("split"),
        F.explode(F.create_map(F.lit("mission"), F.col("source"), F.lit("conversation_id"), F.sha2("text", 256), F.lit("scenario_group"), F.when(F.col("lang") != "en", F.col("lang")))).alias("kind", "owner"),
    ).where("owner IS NOT NULL")
    spread = records.groupBy("kind", "owner").agg(F.bit_or(F.when(F.col("split") == "train", 1).when(F.col("split") == "validation", 2).otherwise(4)).alias("bits"))
    return spread.select("kind", "owner", F.bit_count("bits").cast("long").alias("splits")).where("splits > 1")


@query(f"""SELECT {_SPLIT.format('doc_id::VARCHAR')} AS split, lang, count(*) AS records, sum(n_chars)::BIGINT AS chars FROM documents
           GROUP BY GROUPING SETS ((split), (lang), (split, lang), ())""")
def dataset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("split", assigned_split(F.col("doc_id").cast("string")))
    split, lang = F.col("split"), F.col("lang")
    return docs.groupingSets([[split], [lang], [split, lang], []], split, lang).agg(F.count(F.lit(1)).alias("records"), F.sum("n_chars").alias("chars"))


@query("""SELECT topic, count(*) AS records FROM (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS topic FROM documents) GROUP BY topic""")
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each topic counts once for a record; the words of a text are its topics."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), " ", -1))).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("records"))


@query(r"""WITH k AS (SELECT p_partkey, replace(lower(p_name), ' ', CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '_' ELSE '--' END) AS slug FROM part)
           SELECT p_partkey, slug, regexp_full_match(slug, '[a-z0-9]+(?:[-_][a-z0-9]+)*') AS valid FROM k""")
def slug_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    slug = F.replace(F.lower("p_name"), F.lit(" "), F.when(k == 0, "-").when(k == 1, "_").otherwise("--"))
    return table(spark, sf_dir, "part").select("p_partkey", slug.alias("slug")).withColumn("valid", F.col("slug").rlike(SLUG))


#: Bytes of needles that are searched by one automaton; beyond that they meet the texts by their hashes.
NEEDLE_BYTES = 16 << 20
#: Characters at a needle's start by whose hash it meets places in texts, where there are too many for an automaton.
ANCHOR = 16


def contained(docs: DataFrame, needles: DataFrame, id_col: str = "doc_id", text_col: str = "text", needle_col: str = "item_id") -> DataFrame:
    """(id, needle): which of the needles (their id and ``text``) stand inside each text.

    While the needles' bytes are counted to be few they are sent to all tasks
    and found in one pass over each text by an automaton.  Beyond
    ``NEEDLE_BYTES`` nothing is collected: the hash of a needle's first
    ``ANCHOR`` characters is joined with the hashes of all places of all texts,
    and what meets is compared in full; shorter needles, of which there are few
    different ones, stay with the automaton.  Empty and null needles are in no
    text; repeated rows of a text give one row for each needle and id.
    """
    told = needles.select(F.col(needle_col).alias("needle"), F.col("text").alias("needle_text")).where("length(needle_text) > 0")
    size = told.agg(F.sum(F.octet_length("needle_text"))).first()[0] or 0
    if size <= NEEDLE_BYTES:
        return _by_automaton(docs, told, id_col, text_col).toDF(id_col, needle_col).distinct()
    long = told.where(F.length("needle_text") >= ANCHOR)
    short = told.where(F.length("needle_text") < ANCHOR)
    anchors = long.withColumn("h", F.xxhash64(F.left("needle_text", F.lit(ANCHOR))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    places = rows.where(F.length("text") >= ANCHOR).select("id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - ANCHOR + 1), lambda i: F.xxhash64(F.substr("text", i, F.lit(ANCHOR)))))).alias("h"))
    # only hashes are matched first; the texts of what matched come after
    met = places.drop("text").join(anchors.select("needle", "h"), "h").select("id", "needle").distinct()
    found = met.join(rows, "id").join(long, "needle").where(F.contains("text", "needle_text")).select("id", "needle")
    return found.unionByName(_by_automaton(docs, short, id_col, text_col)).toDF(id_col, needle_col).distinct()


def _by_automaton(docs: DataFrame, needles: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, needle) by one automaton over all needles, which the caller has counted."""
    by_text: dict[str, list] = {}
    for r in needles.collect():
        by_text.setdefault(r["needle_text"], []).append(r["needle"])
    shared = docs.sparkSession.sparkContext.broadcast(by_text)
    id_type, needle_type = docs.schema[id_col].dataType.simpleString(), needles.schema["needle"].dataType.simpleString()

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, names in shared.value.items():
            automaton.add_word(text, names)
        automaton.make_automaton()
        for batch in batches:
            ids, found = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = {x for _, names in automaton.iter(text) for x in names} if text and shared.value else ()
                for x in sorted(hits):
                    ids.append(name)
                    found.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(found, kind)], ["id", "needle"])

    kind = to_arrow_type(needles.schema["needle"].dataType)
    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, needle {needle_type}")


def paragraphs(targets: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, ``text``): the paragraphs of each target, apart at empty lines, without white space around them; those without a character are left out."""
    each = F.explode(F.split(text_col, "\n\n", -1))
    bare = F.regexp_replace(F.regexp_replace("p", r"(?U)^\s+", ""), r"(?U)\s+\z", "")
    return targets.select(id_col, each.alias("p")).select(id_col, bare.alias("text")).where("length(text) > 0").distinct()


@query(r"""SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN (SELECT item_id, regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '') AS p FROM
    (SELECT item_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10))) AS p FROM benchmark)) b ON contains(d.text, b.p) WHERE length(b.p) > 0""")
def leakage_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold any paragraph of a target; each sentence of the benchmark is made a paragraph of its own."""
    targets = table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return contained(table(spark, sf_dir, "documents"), paragraphs(targets, "item_id"))


def loss_examples(rows: DataFrame, prefix_col: str, ids_col: str, most: int, least: int = 2, mask: bool = True, pad_to: int | None = None, ignore: int = -100) -> DataFrame:
    """``rows`` with ``input_ids``, ``attention_mask`` and ``labels``, and a ``fault`` where there are not ``least`` to ``most`` ids, which are never cut.

    ``prefix_col`` is how many ids stand before the target: their labels are
    ``ignore``, unless ``mask`` is off and the whole example is learned.  With
    ``pad_to`` ids are filled up with 0, masked out and ignored.  Null ids count
    as none.
    """
    ids = F.coalesce(F.col(ids_col).cast("array<bigint>"), F.array().cast("array<bigint>"))
    n = F.size("input_ids")
    labels = F.transform("input_ids", lambda x, i: F.when(i < F.coalesce(F.col(prefix_col), F.lit(0)), F.lit(ignore).cast("long")).otherwise(x)) if mask else F.col("input_ids")
    out = rows.withColumn("input_ids", ids).withColumns({"attention_mask": F.transform("input_ids", lambda x: F.lit(1).cast("long")), "labels": labels})
    out = out.withColumn("fault", F.when(~n.between(least, most), F.lit(f"expected {least}..{most} tokens")))
    if pad_to is None:
        return out
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v).cast("long"), F.greatest(F.lit(pad_to) - F.size(c), F.lit(0))))
    return out.withColumns({"input_ids": fill("input_ids", 0), "attention_mask": fill("attention_mask", 0), "labels": fill("labels", ignore)})


@query("""WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)::BIGINT) AS ids FROM documents)
           SELECT doc_id, len(ids)::BIGINT AS tokens, list_sum(list_transform(ids, lambda x, i: CASE WHEN i <= doc_id % 9 THEN -100 ELSE x END))::BIGINT - 100 * greatest(64 - len(ids), 0) AS label_sum,
             len(list_filter(list_transform(ids, lambda x, i: CASE WHEN i <= doc_id % 9 THEN -100 ELSE x END), lambda x: x = -100))::BIGINT + greatest(64 - len(ids), 0) AS masked,
             greatest(64, len(ids))::BIGINT AS padded, CASE WHEN len(ids) NOT BETWEEN 2 AND 300 THEN 'expected 2..300 tokens' END AS fault FROM t""")
def loss_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its prefix masked by -100 and padded; one that would be refused for its length stays and is named so."""
    ids = F.transform(F.split("text", " ", -1), lambda w: F.length(w).cast("long"))
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"), (F.col("doc_id") % 9).alias("prefix"))
    told = loss_examples(rows, "prefix", "ids", 300, pad_to=64)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return told.select("doc_id", total("attention_mask").alias("tokens"), total("labels").alias("label_sum"), F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("masked"), F.size("input_ids").cast("long").alias("padded"), "fault")


@query("""SELECT 'labelled, not a document' AS difference, count(*) AS rows FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
           UNION ALL SELECT 'document without a label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def inventory_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set equality of two inventories, both ways."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("difference"), "rows")
    return count(labels.join(docs, "doc_id", "left_anti"), "labelled, not a document").unionByName(count(docs.join(labels, "doc_id", "left_anti"), "document without a label"))


def led_by_system(messages: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, ``leads``): whether the first message of each conversation (id, turn, role) is the system's and no other is; curated data must be so."""
    system = F.col("role") == "system"
    found = messages.groupBy(id_col).agg(F.min("turn").alias("__first"), F.min(F.when(system, F.col("turn"))).alias("__system"), F.count_if(system).alias("__n"))
    return found.select(id_col, F.coalesce((F.col("__n") == 1) & (F.col("__system") == F.col("__first")), F.lit(False)).alias("leads"))


@query("""SELECT conv_id, coalesce(count(*) FILTER (role = 'system') = 1 AND min(turn) FILTER (role = 'system') = min(turn), false) AS leads FROM conversations GROUP BY conv_id""")
def leading_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return led_by_system(table(spark, sf_dir, "conversations"))


def eligible_references(candidates: DataFrame, target: DataFrame, seen: DataFrame, split: str) -> DataFrame:
    """Candidates (scene_id, mission, path, line, scenario_group, conversation_id, split, owner_split) that may be read beside a target, each with why not as ``fault``.

    ``target``: mission, path, line, scenario_group, role (``target`` for the
    target and its definitions, ``ancestor`` for missions that come before it);
    ``seen``: path, line of what the history shows.  A reference must stand in a
    file of the target, be neither it nor its ancestor nor of its scenario, not
    be shown already, and neither its mission nor its conversation's owner may
    be held out by a later split (null: nobody's).
    """
    from .retrieval import SPLITS

    t = checked(target.select("mission", "path", "line", "scenario_group", "role"))
    paths = t.where("role = 'target'").select("path").distinct()
    flags = [
        ("other file", candidates.select("path").distinct().join(paths, "path", "left_anti").select("path"), ["path"]),
        ("target", t.where("role = 'target'").select("path", "line").distinct(), ["path", "line"]),
        ("ancestor", t.where("role = 'ancestor'").select("mission").distinct(), ["mission"]),
        ("same scenario", t.where("scenario_group IS NOT NULL AND role = 'target'").select("scenario_group").distinct(), ["scenario_group"]),
        ("shown", seen.select("path", "line").distinct(), ["path", "line"]),
    ]
    out, fault = candidates, F.lit(None).cast("string")
    for k, (name, rows, keys) in enumerate(flags):
        out = out.join(rows.withColumn(f"__{k}", F.lit(name)), keys, "left")
        fault = F.coalesce(fault, F.col(f"__{k}"))
    late = lambda c: F.when(F.col(c).isin(*SPLITS[SPLITS.index(split) + 1 :]), "later split")
    return out.select(*candidates.columns, F.coalesce(fault, late("split"), late("owner_split")).alias("fault"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'train' WHEN 'N' THEN 'validation' ELSE 'test' END AS split, CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'test' END AS owner_split FROM lineitem),
    t AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_orderkey < 8)
    SELECT c.l_orderkey, c.l_linenumber, CASE WHEN NOT c.l_suppkey IN (SELECT l_suppkey FROM t) THEN 'other file' WHEN c.l_orderkey < 8 THEN 'target' WHEN c.l_orderkey BETWEEN 8 AND 40 THEN 'ancestor' WHEN c.l_partkey < 10 THEN 'same scenario'
      WHEN c.l_linenumber = 7 THEN 'shown' WHEN c.split = 'test' OR c.owner_split = 'test' THEN 'later split' END AS fault FROM c""")
def reference_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as candidates: suppliers as files, orders as missions, low parts as one scenario, the first orders as the target and what leads to it."""
    lines = table(spark, sf_dir, "lineitem")
    split = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "validation").otherwise("test")
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    c = lines.select(
        place.alias("scene_id"), F.col("l_orderkey").alias("mission"), F.col("l_suppkey").alias("path"), place.alias("line"), F.when(F.col("l_partkey") < 10, "low").alias("scenario_group"),
        "l_orderkey", "l_linenumber", split.alias("split"), F.when(F.col("l_linestatus") == "O", "train").otherwise("test").alias("owner_split"),
    )
    role = F.when(F.col("mission") < 8, "target").when(F.col("mission") <= 40, "ancestor")
    target = c.select("mission", "path", "line", F.lit("low").alias("scenario_group"), role.alias("role")).where("role IS NOT NULL")
    seen = c.where("l_linenumber = 7").select("path", "line")
    return eligible_references(c, target, seen, "validation").select("l_orderkey", "l_linenumber", "fault")
