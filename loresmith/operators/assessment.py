"""Blinded trials and their outcomes: tallies, paired differences, coverage, controls, bootstrap intervals.

``labels`` stand in for decisions: the document is the sample, and statuses and
choices are made of its id and labels.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query, table
from .selection import balanced_sides
from .shared import staged

OUTCOMES = ("correct", "incorrect", "abstained", "failed", "missing")


def rate(part: Column, whole: Column) -> Column:
    """A quotient, null where there is nothing to divide by."""
    return F.round(F.try_divide(part, whole), 9)


def tally(rows: DataFrame, keys: Sequence[str] = (), outcome: str = "outcome") -> DataFrame:
    """Counts of each outcome; accuracy over the decided ones alone, the other rates over all scheduled."""
    counts = [F.count_if(F.col(outcome) == x).alias(x) for x in OUTCOMES]
    found = rows.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("scheduled"))
    decided = F.col("correct") + F.col("incorrect")
    return found.select(*found.columns, rate(F.col("correct"), decided).alias("accuracy"), *(rate(F.col(x), F.col("scheduled")).alias(f"{x}_rate") for x in OUTCOMES[2:]))


def _outcome() -> Column:
    d = F.col("doc_id")
    return F.when(d % 11 == 0, "missing").when(d % 13 == 0, "failed").when(d % 5 == 0, "abstained").when(F.col("quality") == F.when(d % 3 == 0, 0).otherwise(1), "correct").otherwise("incorrect")


_OUTCOME = """CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'abstained'
    WHEN quality = CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END THEN 'correct' ELSE 'incorrect' END"""
_TALLY = """count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'incorrect') AS incorrect, count(*) FILTER (outcome = 'abstained') AS abstained,
    count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'missing') AS missing, count(*) AS scheduled"""
_RATES = """round(correct::DOUBLE / nullif(correct + incorrect, 0), 9) AS accuracy, round(abstained::DOUBLE / nullif(scheduled, 0), 9) AS abstained_rate,
    round(failed::DOUBLE / nullif(scheduled, 0), 9) AS failed_rate, round(missing::DOUBLE / nullif(scheduled, 0), 9) AS missing_rate"""


@query(f"WITH o AS (SELECT toxic, {_OUTCOME} AS outcome FROM labels), t AS (SELECT toxic, {_TALLY} FROM o GROUP BY toxic) SELECT *, {_RATES} FROM t")
def outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(table(spark, sf_dir, "labels").withColumn("outcome", _outcome()), ["toxic"])


@query(f"""WITH o AS (SELECT doc_id % 4 AS recognised, {_OUTCOME} AS outcome FROM labels),
    s AS (SELECT 'recognised' AS part, outcome FROM o WHERE recognised = 1 UNION ALL SELECT 'unrecognised', outcome FROM o WHERE recognised = 0 UNION ALL SELECT 'all', outcome FROM o),
    t AS (SELECT part, {_TALLY} FROM s GROUP BY part) SELECT *, {_RATES} FROM t""")
def tally_by_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised means true, unrecognised means false, and the unknown is in neither."""
    k = F.col("doc_id") % 4
    recognised = F.when(k == 1, True).when(k == 0, False)
    parts = F.array_compact(F.array(F.lit("all"), F.when(recognised, "recognised"), F.when(~recognised, "unrecognised")))
    return tally(table(spark, sf_dir, "labels").select(_outcome().alias("outcome"), F.explode(parts).alias("part")), ["part"])


def coverage(selected: DataFrame, responses: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """(condition, sample_id, identity, status, error): every selected sample (sample_id, identity) in every condition; a sample without a response (condition, sample_id, status, error) is missing.

    The conditions are a stated list that is spread by a literal.  A response of
    no selected sample or a second one of a sample is refused.
    """
    wanted = selected.select("sample_id", "identity", F.explode(F.array(*map(F.lit, conditions))).alias("condition"))
    told = responses.select("condition", "sample_id", "status", "error")
    once = told.groupBy("condition", "sample_id").agg(F.count(F.lit(1)).alias("__n")).join(wanted.select("condition", "sample_id", F.lit(True).alias("__wanted")), ["condition", "sample_id"], "left")
    if bad := once.where("__n > 1 OR __wanted IS NULL").first():
        raise ValueError(f"a response of no selected sample, or more than one: {bad.condition!r}, {bad.sample_id!r}")
    return wanted.join(told, ["condition", "sample_id"], "left").select("condition", "sample_id", "identity", F.coalesce("status", F.lit("missing")).alias("status"), "error")


def coverage_counts(rows: DataFrame) -> DataFrame:
    """Selected, ok, failed and missing samples of each condition, by identity and over ``ALL``."""
    c, i = F.col("condition"), F.col("identity")
    found = rows.groupingSets([[c], [c, i]], c, i).agg(F.count(F.lit(1)).alias("selected"), *(F.count_if(F.col("status") == x).alias(x) for x in ("ok", "failed", "missing")), F.grouping(i).alias("__all"))
    return found.withColumn("identity", F.when(F.col("__all") == 1, "ALL").otherwise(F.col("identity"))).drop("__all")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as responses, in the condition of their document's language."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.when(F.col("quality") == 0, "failed").otherwise("ok").alias("status"), F.when(F.col("quality") == 0, "no text").alias("error"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("condition"))
    return docs.join(labels, "sample_id")


LANGUAGES = ("en", "de", "fr", "es")
_COVERAGE = """SELECT c.condition, d.doc_id AS sample_id, d.source AS identity, CASE WHEN l.doc_id IS NULL OR d.lang <> c.condition THEN 'missing' WHEN l.quality = 0 THEN 'failed' ELSE 'ok' END AS status
    FROM documents d CROSS JOIN (SELECT unnest(['en', 'de', 'fr', 'es']) AS condition) c LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("identity"))
    return coverage(selected, _responses(spark, sf_dir).where(F.col("condition").isin(*LANGUAGES)), LANGUAGES)


@query(f"SELECT condition, sample_id, status, CASE WHEN status = 'failed' THEN 'no text' END AS error FROM ({_COVERAGE})")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scheduled sample has a status; one without a result is missing."""
    return _covered(spark, sf_dir).drop("identity")


@query(f"""SELECT condition, coalesce(identity, 'ALL') AS identity, count(*) AS selected, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'missing') AS missing
    FROM ({_COVERAGE}) GROUP BY GROUPING SETS ((condition), (condition, identity))""")
def generation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_counts(_covered(spark, sf_dir))


# judgments

#: What a judgment may say of itself.
STATUSES, CHOICES = ("ok", "failed", "missing"), ("A", "B", "abstain")
JUDGMENT = "trial_id string, trial_sha256 string, status string, choice string, confidence double, reason string, recognized_source boolean, error string"
#: What only the organiser may say of a trial.
ORGANISER_FIELDS = ("sample_id", "condition", "kind", "original", "identity", "group", "control", "path", "reviewer")


def judgment_fault(raw: Column | None = None) -> Column:
    """The first broken rule of a judgment's columns, null if it is sound.

    ``raw`` is the judgment's JSON where there is one: then ``recognized_source``
    must stand there as true or false, since 1 is no answer, and no field of the
    organiser may be named.
    """
    status, choice, confidence = F.col("status"), F.col("choice"), F.col("confidence")
    ok = status == "ok"
    blank = F.coalesce(~F.col("reason").rlike(r"(?U)\S"), F.lit(True))
    strict = F.col("recognized_source").isNull() if raw is None else ~F.coalesce(F.get_json_object(raw, "$.recognized_source").isin("true", "false") & raw.rlike(r'"recognized_source"\s*:\s*(true|false)'), F.lit(False))
    taken = F.lit(False) if raw is None else F.coalesce(F.arrays_overlap(F.json_object_keys(raw), F.array(*map(F.lit, ORGANISER_FIELDS))), F.lit(False))
    return (
        F.when(taken, "field of the organiser").when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "status")
        .when(~ok & (choice.isNotNull() | confidence.isNotNull()), "choice without result")
        .when((status == "failed") & F.coalesce(~F.col("error").rlike(r"(?U)\S"), F.lit(True)), "failure without error")
        .when(ok & ~F.coalesce(choice.isin(*CHOICES), F.lit(False)), "no choice").when(ok & (choice == "abstain") & confidence.isNotNull(), "confidence of abstention")
        .when(ok & (choice != "abstain") & ~F.coalesce(confidence.between(0, 1), F.lit(False)), "confidence")
        .when(ok & blank, "reason").when(ok & strict, "recognition")
    )


def parsed_judgments(lines: DataFrame, text_col: str = "text", keys: Sequence[str] = ("choice", "confidence", "reason", "recognized_source")) -> DataFrame:
    """A judge's answers as text: the object's fields and ``fault``: ``not an object``, ``fields`` where its keys are not exactly ``keys``, else null."""
    told = F.json_object_keys(text_col)
    fault = F.when(told.isNull(), "not an object").when(F.array_sort(told) != F.array(*map(F.lit, sorted(keys))), "fields")
    kinds = {k: d for k, d in (x.split() for x in JUDGMENT.split(", "))}
    parsed = F.from_json(text_col, ", ".join(f"{k} {kinds.get(k, 'string')}" for k in keys))
    rows = lines.withColumn("__p", parsed).withColumn("fault", fault)
    return rows.select(*lines.columns, *(F.when(F.col("fault").isNull(), F.col("__p")[k]).alias(k) for k in keys), "fault")


def judge_request(context: Column, a: Column, b: Column, name: Column) -> Column:
    """The four public fields of a trial as JSON that a judge's prompt quotes; nothing else of the trial is in it."""
    return F.to_json(F.struct(name.alias("trial_id"), context.alias("context"), a.alias("A"), b.alias("B")))


def trial_hash(trial: Column) -> Column:
    return F.sha2(trial, 256)


def joined_judgments(judgments: DataFrame, trials: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Judgments (keys, trial_id, trial_sha256, ...) with their trials (trial_id, trial_sha256, ...).

    An unknown trial, a second judgment of one (by ``keys``, a reviewer say) or
    the hash of another text is refused by an error that names it.
    """
    told = trials.withColumnRenamed("trial_sha256", "__true").withColumn("__known", F.lit(True))
    joined = judgments.join(told, "trial_id", "left")
    again = F.count(F.lit(1)).over(Window.partitionBy(*keys, "trial_id"))
    fault = F.when(F.col("__known").isNull(), "unknown trial").when(F.col("__n") > 1, "judged twice").when(~F.col("trial_sha256").eqNullSafe(F.col("__true")), "hash differs")
    return refusing(joined.withColumn("__n", again), fault, F.col("trial_id")).drop("__true", "__known", "__n")


def refusing(rows: DataFrame, fault: Column, name: Column) -> DataFrame:
    """``rows`` as they are; one with a fault ends the query by an error that tells fault and name."""
    return rows.where(F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(": "), F.coalesce(name.cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.lit(True)))


def reviewer_by_trial(trials: DataFrame, reviewers: Sequence[str], judgments: DataFrame) -> DataFrame:
    """(reviewer, trial, judgment): each of a stated list of reviewers against each trial; a judgment (reviewer, trial_id, status, ...) that is not there has the status missing."""
    spread = trials.select("*", F.explode(F.array(*map(F.lit, reviewers))).alias("reviewer"))
    return spread.join(judgments, ["trial_id", "reviewer"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def outcome_of(status: Column, choice: Column, original: Column) -> Column:
    """What a judgment comes to: the status itself unless ok; then abstained, or whether it names the original (a trial without one has no right answer)."""
    return F.when(status != "ok", status).when(choice == "abstain", "abstained").when(F.coalesce(choice == original, F.lit(False)), "correct").otherwise("incorrect")


_JUDGED = """SELECT left(sha256(concat('trial:', doc_id::VARCHAR)), 32) AS trial_id, doc_id, CASE WHEN quality = 1 THEN 'ada' ELSE 'bo' END AS reviewer,
      CASE WHEN doc_id % 13 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'abstain' WHEN doc_id % 3 = 0 THEN 'B' ELSE 'A' END AS choice FROM labels WHERE toxic = 0"""


def opaque(*parts: Column) -> Column:
    """A name of 128 bits that tells nothing of what it is made of."""
    return F.left(F.sha2(F.concat_ws(":", F.lit("trial"), *(p.cast("string") for p in parts)), 256), F.lit(32))


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("/", F.col("doc_id").cast("string"), "quality")
    return table(spark, sf_dir, "labels").select(opaque(F.col("doc_id")).alias("trial_id"), "doc_id", trial_hash(text).alias("trial_sha256"), F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("original"))


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    choice = F.when(d % 13 == 0, None).when(d % 5 == 0, "abstain").when(d % 3 == 0, "B").otherwise("A")
    return table(spark, sf_dir, "labels").where("toxic = 0").select(
        opaque(d).alias("trial_id"), trial_hash(F.concat_ws("/", d.cast("string"), "quality")).alias("trial_sha256"), F.when(F.col("quality") == 1, "ada").otherwise("bo").alias("reviewer"),
        F.when(d % 13 == 0, "failed").otherwise("ok").alias("status"), choice.alias("choice"),
    )


@query(f"""SELECT j.reviewer, CASE WHEN status <> 'ok' THEN status WHEN choice = 'abstain' THEN 'abstained' WHEN choice = CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END THEN 'correct' ELSE 'incorrect' END AS outcome, count(*) AS trials
    FROM ({_JUDGED}) j GROUP BY ALL""")
def judgment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments meet their trials by id and hash; an unknown or repeated one would end the query."""
    joined = joined_judgments(_judgments(spark, sf_dir), _trials(spark, sf_dir), ["reviewer"])
    return joined.groupBy("reviewer", outcome_of(F.col("status"), F.col("choice"), F.col("original")).alias("outcome")).agg(F.count(F.lit(1)).alias("trials"))


@query(f"""SELECT r.reviewer, coalesce(j.status, 'missing') AS status, count(*) AS trials FROM labels t CROSS JOIN (SELECT unnest(['ada', 'bo', 'cy']) AS reviewer) r
    LEFT JOIN ({_JUDGED}) j ON j.doc_id = t.doc_id AND j.reviewer = r.reviewer GROUP BY ALL""")
def reviewer_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reviewer against each trial; what nobody judged is missing.  The list is spread by a literal, so no cross join is planned."""
    found = reviewer_by_trial(_trials(spark, sf_dir).select("trial_id"), ("ada", "bo", "cy"), _judgments(spark, sf_dir))
    return found.groupBy("reviewer", "status").agg(F.count(F.lit(1)).alias("trials"))


@query("""WITH j AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'missing' WHEN 2 THEN 'odd' ELSE 'ok' END AS status,
                  CASE WHEN doc_id % 5 < 3 THEN ['A', 'B', 'abstain'][(doc_id % 5 + 1)::INT] END AS choice, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality / 2.0 END AS confidence,
                  CASE WHEN toxic = 1 THEN 'reason' END AS error, CASE doc_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'because' END AS reason, CASE WHEN doc_id % 17 > 0 THEN quality = 1 END AS recognized_source FROM labels)
           SELECT doc_id, CASE WHEN status NOT IN ('ok', 'failed', 'missing') THEN 'status' WHEN status <> 'ok' AND (choice IS NOT NULL OR confidence IS NOT NULL) THEN 'choice without result'
             WHEN status = 'failed' AND error IS NULL THEN 'failure without error' WHEN status = 'ok' AND choice IS NULL THEN 'no choice'
             WHEN status = 'ok' AND choice = 'abstain' AND confidence IS NOT NULL THEN 'confidence of abstention' WHEN status = 'ok' AND choice <> 'abstain' AND (confidence IS NULL OR confidence NOT BETWEEN 0 AND 1) THEN 'confidence'
             WHEN status = 'ok' AND trim(coalesce(reason, '')) = '' THEN 'reason' WHEN status = 'ok' AND recognized_source IS NULL THEN 'recognition' END AS fault FROM j""")
def judgment_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, choice, confidence, reason, recognition and error of judgments must fit each other; the first broken rule is named."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(d % 7 == 0, "failed").when(d % 7 == 1, "missing").when(d % 7 == 2, "odd").otherwise("ok").alias("status"),
        F.when(d % 5 == 0, "A").when(d % 5 == 1, "B").when(d % 5 == 2, "abstain").alias("choice"), F.when(d % 3 != 0, F.col("quality") / 2.0).alias("confidence"), F.when(F.col("toxic") == 1, "reason").alias("error"),
        F.when(d % 11 == 1, "  ").when(d % 11 > 1, "because").alias("reason"), F.when(d % 17 > 0, F.col("quality") == 1).alias("recognized_source"),
    )
    return rows.select("doc_id", judgment_fault().alias("fault"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'fields' WHEN 2 THEN 'fields' ELSE 'not an object' END AS fault, CASE WHEN doc_id % 4 = 0 THEN 'A' END AS choice,
    CASE WHEN doc_id % 4 = 0 THEN round(quality / 2.0, 9) END AS confidence FROM labels""")
def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a judge as text: whole, with a field too many, with one too few, and cut off."""
    d, q = F.col("doc_id"), F.format_number(F.col("quality") / 2.0, 1)
    whole = F.concat(F.lit('{"choice": "A", "confidence": '), q, F.lit(', "reason": "clear", "recognized_source": false'))
    text = F.when(d % 4 == 0, F.concat(whole, F.lit("}"))).when(d % 4 == 1, F.concat(whole, F.lit(', "sample_id": 3}'))).when(d % 4 == 2, '{"choice": "A"}').otherwise(whole)
    return parsed_judgments(table(spark, sf_dir, "labels").select("doc_id", text.alias("text"))).select("doc_id", "fault", "choice", F.round("confidence", 9).alias("confidence"))


# comparisons


def paired_differences(values: DataFrame, universe: DataFrame, conditions: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """By keys (a reviewer, say) and pair of conditions in their stated order: ``complete`` and ``incomplete`` pairs over the universe of samples, and the mean of right minus left.

    ``values``: keys, sample_id, condition, value (null: undecided); ``universe``:
    sample_id, the samples that were to be covered, whether or not a trial came
    of them.  A sample's values meet in one row by an aggregate, so nothing is
    joined to itself; the pairs of a sample without any value are counted, not made.
    """
    at = {c: F.max(F.when(F.col("condition") == c, F.col("value"))) for c in conditions}
    rows = values.join(universe.select("sample_id").distinct(), "sample_id", "left_semi").groupBy(*keys, "sample_id").agg(*(v.alias(f"__{c}") for c, v in at.items()))
    pairs = F.array(*(F.struct(F.lit(a).alias("left_condition"), F.lit(b).alias("right_condition"), F.col(f"__{a}").alias("x"), F.col(f"__{b}").alias("y")) for i, a in enumerate(conditions) for b in conditions[i + 1 :]))
    p = rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    found = p.groupBy(*keys, "left_condition", "right_condition").agg(F.count_if(both).alias("complete"), F.round(F.avg(F.when(both, F.col("y") - F.col("x"))), 9).alias("difference"))
    size = universe.agg(F.count_distinct("sample_id")).first()[0]
    return found.select(*keys, "left_condition", "right_condition", "complete", (F.lit(size) - F.col("complete")).alias("incomplete"), "difference")


_VALUES = """SELECT doc_id, c AS condition, CASE WHEN (doc_id * 7 + c) % 6 = 0 THEN NULL ELSE ((doc_id * (c + 3)) % 5 < 2 + quality)::INT END AS value FROM labels, (VALUES (0), (1), (2)) t(c)"""


@query(f"""WITH v AS ({_VALUES}), n AS (SELECT count(DISTINCT doc_id) AS size FROM documents),
    p AS (SELECT a.condition::VARCHAR AS left_condition, b.condition::VARCHAR AS right_condition, a.value AS x, b.value AS y FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.condition < b.condition)
    SELECT left_condition, right_condition, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS complete, (SELECT size FROM n) - count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS incomplete, round(avg(y - x), 9) AS difference
    FROM p GROUP BY ALL""")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are the universe, labels have values in three conditions."""
    d, q = F.col("doc_id"), F.col("quality")
    each = F.explode(F.array(*map(F.lit, range(3))))
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", each.alias("c"))
    value = F.when((d * 7 + F.col("c")) % 6 != 0, F.when((d * (F.col("c") + 3)) % 5 < 2 + q, 1).otherwise(0))
    values = rows.select(d.alias("sample_id"), F.col("c").cast("string").alias("condition"), value.alias("value"))
    return paired_differences(values, table(spark, sf_dir, "documents").select(d.alias("sample_id")), ("0", "1", "2"))


def disagreeing(judgments: DataFrame) -> DataFrame:
    """(trial_id, choices): trials (trial_id, status, choice) whose sound judgments differ."""
    found = judgments.where("status = 'ok' AND choice IS NOT NULL").groupBy("trial_id").agg(F.array_sort(F.collect_set("choice")).alias("choices"))
    return found.where(F.size("choices") > 1)


@query("""SELECT user_id AS trial_id, list_sort(list(DISTINCT event_type)) AS choices FROM events WHERE event_type <> 'error' GROUP BY user_id HAVING count(DISTINCT event_type) > 1""")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials on which sound judgments differ."""
    e = F.col("event_type")
    return disagreeing(table(spark, sf_dir, "events").where(e != "error").select(F.col("user_id").alias("trial_id"), F.lit("ok").alias("status"), e.alias("choice")))


def control_matches(judged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """By keys and ``control``: how many controls (control, status, choice, original), how many came out as expected, and how many say nothing.

    An ``identical`` control is to be abstained from, a ``wrong-context`` one to
    name the original; a judgment that is not sound decides nothing.
    """
    matched = F.when(F.col("status") == "ok", F.when(F.col("control") == "identical", F.col("choice") == "abstain").otherwise(F.coalesce(F.col("choice") == F.col("original"), F.lit(False))))
    rows = judged.where("control IS NOT NULL").withColumn("__m", matched)
    return rows.groupBy(*keys, "control").agg(F.count(F.lit(1)).alias("controls"), F.count_if("__m").alias("matches"), F.count_if(F.col("__m").isNull()).alias("undecided"))


@query(f"""SELECT control, count(*) AS controls, count(*) FILTER (status = 'ok' AND CASE WHEN control = 'identical' THEN choice = 'abstain' ELSE choice = CASE WHEN doc_id % 4 = 1 THEN 'A' ELSE 'B' END END) AS matches,
    count(*) FILTER (status <> 'ok') AS undecided FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'identical' ELSE 'wrong-context' END AS control FROM ({_JUDGED})) GROUP BY control""")
def control_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    trials = _trials(spark, sf_dir).select("trial_id", F.when(d % 2 == 0, "identical").otherwise("wrong-context").alias("control"), F.when(d % 2 == 1, F.when(d % 4 == 1, "A").otherwise("B")).alias("original"))
    return control_matches(_judgments(spark, sf_dir).join(trials, "trial_id"))


def contexts_apart(runs: DataFrame) -> DataFrame:
    """(sample_id, contexts): samples whose runs (condition, sample_id, context) do not have one context in common."""
    found = runs.groupBy("sample_id").agg(F.count_distinct(F.sha2(F.coalesce("context", F.lit("\\0")), 256)).alias("contexts"))
    return found.where("contexts > 1")


@query("""SELECT source AS sample_id, count(DISTINCT lang) AS contexts FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1""")
def shared_context_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts_apart(table(spark, sf_dir, "documents").select(F.col("source").alias("sample_id"), F.col("lang").alias("context")))


# construction of trials


def assembled(rows: DataFrame, seed: str = "blind") -> DataFrame:
    """One blinded trial for each sound response, and for each control.

    ``rows``: condition, sample_id, identity, status, context, target, response,
    and ``control`` (null for a primary trial; ``identical``: both sides are the
    target; ``wrong-context``: the response is another sample's target).  Sides
    are dealt so that within a condition and kind they differ by one at most.
    Returned with the public columns trial_id, context, A, B, and the private
    ones sample_id, condition, identity, stage, control, original (null where
    both sides are the same), trial_sha256.
    """
    kinds = rows.where("status = 'ok'").withColumn("kind", F.concat_ws("/", "condition", F.coalesce("control", F.lit("primary"))))
    sound = kinds.withColumn("trial_id", opaque(F.lit(seed), F.col("condition"), F.coalesce("control", F.lit("primary")), F.col("sample_id")))
    sides = balanced_sides(sound, ["kind"], "trial_id", seed).select("trial_id", "side")
    t = sound.join(sides, "trial_id")
    first = F.col("side") == "A"
    other = F.when(F.col("control") == "identical", F.col("target")).otherwise(F.col("response"))
    t = t.withColumns({"A": F.when(first, F.col("target")).otherwise(other), "B": F.when(first, other).otherwise(F.col("target"))})
    original = F.when(F.coalesce(F.col("control") == "identical", F.lit(False)), None).otherwise(F.col("side"))
    stage = F.when(F.col("control").isNull(), "primary").otherwise("controls")
    digest = trial_hash(judge_request(F.col("context"), F.col("A"), F.col("B"), F.col("trial_id")))
    return t.select("trial_id", "context", "A", "B", "sample_id", "condition", "identity", stage.alias("stage"), "control", original.alias("original"), digest.alias("trial_sha256"))


def controls(samples: DataFrame, donors: DataFrame) -> DataFrame:
    """Rows for :func:`assembled` of both kinds of control: samples (condition, sample_id, identity, context, target) against themselves, and against the target of their donor (sample_id, donor_id).

    A sample that is its own donor, or whose donor is none of the samples, is refused.
    """
    same = samples.select("*", F.lit("ok").alias("status"), F.col("target").alias("response"), F.lit("identical").alias("control"))
    texts = samples.select(F.col("sample_id").alias("donor_id"), F.col("target").alias("response")).dropDuplicates(["donor_id"])
    told = samples.join(donors, "sample_id").join(texts, "donor_id", "left")
    fault = F.when(F.col("donor_id") == F.col("sample_id"), "a sample cannot be its own donor").when(F.col("response").isNull(), "the donor is no sample")
    other = refusing(told, fault, F.col("sample_id")).select(*samples.columns, F.lit("ok").alias("status"), "response", F.lit("wrong-context").alias("control"))
    return same.unionByName(other)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("condition"), F.col("doc_id").alias("sample_id"), F.col("source").alias("identity"), F.concat(F.lit("context "), "source").alias("context"), F.md5("text").alias("target"))


@query("""WITH t AS (SELECT d.doc_id, d.lang, 'context ' || d.source AS context, md5(d.text) AS target, md5(d.text || 'x') AS response, left(sha256(concat('trial:blind:', d.lang, ':primary:', d.doc_id::VARCHAR)), 32) AS trial_id
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('blind:', trial_id)), trial_id) % 2 = 1 AS first FROM t)
    SELECT trial_id, context, CASE WHEN first THEN target ELSE response END AS "A", CASE WHEN first THEN response ELSE target END AS "B", doc_id AS sample_id, lang AS condition, CASE WHEN first THEN 'A' ELSE 'B' END AS original,
      sha256('{"trial_id":"' || trial_id || '","context":"' || context || '","A":"' || CASE WHEN first THEN target ELSE response END || '","B":"' || CASE WHEN first THEN response ELSE target END || '"}') AS trial_sha256 FROM k""")
def trial_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One opaque trial for each sound response, sides in turn down the order of a hash, bound to its key by a hash of what is public."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"))
    response = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.md5(F.concat("text", F.lit("x"))).alias("response"))
    rows = _samples(spark, sf_dir).join(response, "sample_id").join(labels, "sample_id").withColumn("control", F.lit(None).cast("string"))
    return assembled(rows).drop("identity", "stage", "control")


@query("""WITH n AS (SELECT max(doc_id) AS m FROM documents), d AS (SELECT doc_id, CASE WHEN doc_id < (SELECT m FROM n) THEN doc_id + 1 ELSE 0 END AS donor_id, md5(text) AS target FROM documents)
    SELECT d.doc_id AS sample_id, 'wrong-context' AS control, e.target AS response FROM d JOIN d e ON e.doc_id = d.donor_id UNION ALL SELECT doc_id, 'identical', target FROM d""")
def wrong_context_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample against itself, and against the target of the next one (the last: of the first)."""
    samples = _samples(spark, sf_dir)
    last = samples.agg(F.max("sample_id")).first()[0] or 0
    donors = samples.select("sample_id", F.when(F.col("sample_id") < last, F.col("sample_id") + 1).otherwise(0).alias("donor_id"))
    return controls(samples, donors).select("sample_id", "control", "response")


def merged_reviews(files: DataFrame, meta: Sequence[str], ignored: Sequence[str] = ("prompt_sha256",)) -> DataFrame:
    """Judgments of several files (reviewer, file, trial_id, metadata columns, ...) as one set for each reviewer.

    A reviewer's files are merged only if their metadata, but for ``ignored``,
    are equal (null to null); they may not judge one trial twice.  Either is
    refused by an error that names the reviewer.
    """
    told = F.sha2(F.to_json(F.struct(*(c for c in meta if c not in ignored)), {"ignoreNullFields": "false"}), 256)
    per = files.withColumn("__told", told).groupBy("reviewer").agg(F.min("__told").alias("__a"), F.max("__told").alias("__b"))
    twice = files.groupBy("reviewer", "trial_id").agg(F.count(F.lit(1)).alias("__n")).groupBy("reviewer").agg(F.max("__n").alias("__n"))
    checked_ = per.join(twice, "reviewer").withColumn("fault", F.when(F.col("__a") != F.col("__b"), "files of a reviewer that differ").when(F.col("__n") > 1, "a trial judged twice by"))
    fine = refusing(checked_, F.col("fault"), F.col("reviewer")).select("reviewer")
    return files.join(fine, "reviewer")


@query("""SELECT event_type AS reviewer, count(*) AS judgments, count(DISTINCT day) AS files FROM (SELECT *, ts::DATE AS day FROM events) GROUP BY event_type""")
def reviewer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as reviewers, days as their files: one set of judgments for each."""
    files = table(spark, sf_dir, "events").select(F.col("event_type").alias("reviewer"), F.to_date("ts").alias("file"), F.col("event_id").alias("trial_id"), F.lit("judge-1").alias("model"), F.sha2(F.to_date("ts").cast("string"), 256).alias("prompt_sha256"))
    return merged_reviews(files, ["model", "prompt_sha256"]).groupBy("reviewer").agg(F.count(F.lit(1)).alias("judgments"), F.count_distinct("file").alias("files"))


def trial_faults(public: DataFrame, private: DataFrame, responses: DataFrame) -> DataFrame:
    """(trial_id, fault) of a pack: public trials (trial_id, context, A, B), private keys, and the responses (condition, sample_id, context, target, response) they must come from.

    Both tables name the same trials, each once; the hash of what is public is
    the key's; the key's side holds the target and the other the response of its
    sample in its condition, or as its control demands.
    """
    p = public.groupBy("trial_id").agg(F.count(F.lit(1)).alias("__p"), *(F.first(c).alias(c) for c in ("context", "A", "B")))
    k = private.groupBy("trial_id").agg(F.count(F.lit(1)).alias("__k"), *(F.first(c).alias(c) for c in ("sample_id", "condition", "control", "original", "trial_sha256")))
    r = responses.select("condition", "sample_id", F.col("context").alias("__context"), F.col("target").alias("__target"), F.col("response").alias("__response"))
    j = p.join(k, "trial_id", "full").join(r, ["condition", "sample_id"], "left")
    digest = trial_hash(judge_request(F.col("context"), F.col("A"), F.col("B"), F.col("trial_id")))
    told = F.when(F.col("original") == "A", F.col("A")).when(F.col("original") == "B", F.col("B"))
    other = F.when(F.col("original") == "A", F.col("B")).when(F.col("original") == "B", F.col("A"))
    same = F.coalesce(F.col("control") == "identical", F.lit(False))
    fault = (
        F.when(F.col("__k").isNull(), "no key").when(F.col("__p").isNull(), "not public").when((F.col("__p") > 1) | (F.col("__k") > 1), "twice").when(digest != F.col("trial_sha256"), "hash differs")
        .when(F.col("__target").isNull(), "no response").when(F.col("context") != F.col("__context"), "context differs")
        .when(same, F.when(F.col("original").isNotNull() | (F.col("A") != F.col("__target")) | (F.col("B") != F.col("__target")), "sides differ"))
        .when(F.coalesce(told != F.col("__target"), F.lit(True)), "original differs").when(F.col("control").isNull() & (other != F.col("__response")), "response differs")
    )
    return j.select("trial_id", fault.alias("fault")).where("fault IS NOT NULL")


@query("""SELECT CASE WHEN d.doc_id % 5 = 0 THEN 'hash differs' ELSE 'original differs' END AS fault, count(*) AS trials FROM documents d WHERE d.doc_id % 5 = 0 OR d.doc_id % 5 = 1 GROUP BY ALL""")
def trial_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack in which some contexts were changed after the keys were made, and some keys name the wrong side."""
    samples = _samples(spark, sf_dir).withColumns({"response": F.reverse("target"), "status": F.lit("ok"), "control": F.lit(None).cast("string")})
    trials = assembled(samples.where(F.col("target") != F.col("response")))
    public = trials.select("trial_id", F.when(F.col("sample_id") % 5 == 0, "changed").otherwise(F.col("context")).alias("context"), "A", "B")
    private = trials.withColumn("original", F.when(F.col("sample_id") % 5 == 1, F.when(F.col("original") == "A", "B").otherwise("A")).otherwise(F.col("original")))
    return trial_faults(public, private, samples).groupBy("fault").agg(F.count(F.lit(1)).alias("trials"))


def met_by_position(plan: DataFrame, first: DataFrame, second: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """Two runs of one plan, met by position: all columns of the plan, and ``first`` and ``second`` as structs.

    A position that one of the three lacks, or has twice, or where ``keys`` differ,
    is refused by an error that names it.
    """
    at = lambda df, name: df.groupBy(position).agg(F.count(F.lit(1)).alias(f"__n_{name}"), F.first(F.struct(*df.columns)).alias(name))
    j = at(plan, "plan").join(at(first, "first"), position, "full").join(at(second, "second"), position, "full")
    n = [F.col(f"__n_{x}") for x in ("plan", "first", "second")]
    differs = [~F.col("plan")[k].eqNullSafe(F.col(x)[k]) for k in keys for x in ("first", "second")]
    fault = F.when(F.coalesce(n[0] + n[1] + n[2], F.lit(0)) != 3, "a position that not all have once")
    for d in differs:
        fault = fault.when(d, "another query at a position")
    return refusing(j, fault, F.col(position)).select("plan.*", "first", "second")


@query("""SELECT label AS query, count(*) AS met, CASE WHEN ('0x' || right(sha256(concat('pair:', label::VARCHAR)), 1))::INT % 2 = 0 THEN 'small' ELSE 'large' END AS first_run FROM embeddings GROUP BY label""")
def ordered_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one plan meet by position and must name the same query; which is shown first hangs on the query's hash, and no score is shown."""
    plan = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("position"), F.col("label").alias("query"))
    packet = pair_packet(met_by_position(plan, plan.withColumn("score", F.lit(0.5)), plan.withColumn("score", F.lit(0.7)), ["query"]), "query", ("small", "large"))
    return packet.groupBy("query", F.col("A.run").alias("first_run")).agg(F.count(F.lit(1)).alias("met"))


def pair_packet(met: DataFrame, query_col: str, runs: tuple[str, str], hidden: Sequence[str] = ("score",)) -> DataFrame:
    """The plan's columns with A and B: the two runs' results without what is hidden, in an order that hangs on the last digit of the query's hash."""
    odd = F.conv(F.right(F.sha2(F.concat(F.lit("pair:"), F.col(query_col).cast("string")), 256), F.lit(1)), 16, 10).cast("int") % 2 == 1
    shown = lambda c, run: F.struct(F.lit(run).alias("run"), *(F.col(c)[x].alias(x) for x in met.select(f"{c}.*").columns if x not in hidden))
    first, second = shown("first", runs[0]), shown("second", runs[1])
    return met.select(*(c for c in met.columns if c not in ("first", "second")), F.when(odd, second).otherwise(first).alias("A"), F.when(odd, first).otherwise(second).alias("B"))


# intervals

#: Groups of one report up to which each repetition draws as many groups as there are, exactly.
EXACT_GROUPS = 10_000


def cluster_bootstrap(rows: DataFrame, group_col: str, value_col: str, keys: Sequence[str] = (), repetitions: int = 2000, seed: int = 42) -> DataFrame:
    """Interval of a mean when whole groups are drawn again, with replacement, as many as there are.

    Groups are first summed to (sum, count), combined before the shuffle.  With
    up to ``EXACT_GROUPS`` groups of a key their sums stand in one array, and a
    repetition draws as many of them as there are, each by a hash of (seed,
    repetition, draw): nothing is exploded but the repetitions.  Beyond that
    number each group draws its own times in a repetition as Poisson(1), which
    is what drawing n of n comes to for so many; partial sums of a task are then
    one pair for each repetition.  Rows: keys, ``groups``, ``contributing``
    (with a value that is not null), ``mean``, ``undefined`` repetitions, and
    ``low``/``high``: order statistics int((n - 1) * q) of the defined means,
    without interpolation; null with fewer than two contributing groups.
    """
    groups = staged(rows.groupBy(*keys, group_col).agg(F.sum(value_col).alias("s"), F.count(value_col).alias("n")))
    seen = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 0).alias("contributing"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    sized = groups.alias("g").join(seen.alias("x"), same("g", "x") or F.lit(True)).select("g.*", F.col("x.groups").alias("k"))
    each = F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("r")

    few = sized.where(F.col("k") <= EXACT_GROUPS).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(group_col).alias("g"), F.col("s").cast("double").alias("s"), "n"))).alias("held")).where(F.size("held") > 0)
    draw = lambda i: (F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), i.cast("string"))), F.lit(8)), 16, 10).cast("long") % F.size("held")).cast("int")
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(F.sequence(F.lit(0), F.size("held") - 1), zero, lambda a, i: F.struct((a["s"] + F.coalesce(F.get("held", draw(i))["s"], F.lit(0.0))).alias("s"), (a["n"] + F.get("held", draw(i))["n"]).alias("n")))
    exact = few.select(*keys, "held", each).select(*keys, "r", total.alias("t")).select(*keys, F.try_divide("t.s", "t.n").alias("m"))

    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), k, F.col(group_col)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    # chances that a Poisson(1) draw is at most 0, 1, 2 and so on
    bounds = list(itertools.accumulate(math.exp(-1) / math.factorial(i) for i in range(9)))
    times = lambda k: F.aggregate(F.array(*map(F.lit, bounds)), F.lit(0), lambda a, b: a + F.when(unit(k) > b, 1).otherwise(0))
    drawn = sized.where(F.col("k") > EXACT_GROUPS).select("*", each).withColumn("t", times(F.col("r"))).where("t > 0")
    many = drawn.groupBy(*keys, "r").agg(F.try_divide(F.sum(F.col("s") * F.col("t")), F.sum(F.col("n") * F.col("t"))).alias("m")).drop("r")

    spread = exact.unionByName(many).groupBy(*keys).agg(F.array_sort(F.collect_list("m")).alias("ms"))  # at most one value per repetition
    at = lambda q: F.element_at("ms", F.floor((F.size("ms") - 1) * q).cast("int") + 1)
    joined = seen.alias("a").join(spread.alias("b"), same("a", "b") or F.lit(True), "left").select("a.*", F.coalesce("b.ms", F.array().cast("array<double>")).alias("ms"))
    enough = (F.col("contributing") >= 2) & (F.size("ms") > 0)
    return joined.select(*keys, "groups", "contributing", "mean", (F.lit(repetitions) - F.size("ms")).cast("long").alias("undefined"), F.when(enough, at(0.025)).alias("low"), F.when(enough, at(0.975)).alias("high"))


@query("""WITH v AS (SELECT d.lang, d.source, CASE WHEN l.doc_id % 7 <> 0 THEN l.quality END AS value FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
    g AS (SELECT lang, source, sum(value)::DOUBLE AS s, count(value) AS n, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS i, count(*) OVER (PARTITION BY lang) AS k FROM v GROUP BY lang, source),
    seen AS (SELECT lang, count(*) AS groups, count(*) FILTER (n > 0) AS contributing, sum(s) / nullif(sum(n), 0) AS mean FROM g GROUP BY lang),
    draws AS (SELECT s.lang, r.r, ('0x' || left(md5(concat('42:', r.r, ':', c.c)), 8))::BIGINT % s.groups AS i FROM seen s, range(2000) r(r), range(0, (SELECT max(groups) FROM seen)) c(c) WHERE c.c < s.groups),
    m AS (SELECT d.lang, d.r, sum(g.s) / nullif(sum(g.n), 0) AS m FROM draws d JOIN g ON g.lang = d.lang AND g.i = d.i GROUP BY d.lang, d.r),
    o AS (SELECT lang, list_sort(list(m) FILTER (m IS NOT NULL)) AS ms, count(*) FILTER (m IS NULL) AS undefined FROM m GROUP BY lang)
    SELECT s.lang, groups, contributing, round(mean, 9) AS mean, undefined, CASE WHEN contributing >= 2 THEN round(ms[floor((len(ms) - 1) * 0.025)::BIGINT + 1], 9) END AS low,
      CASE WHEN contributing >= 2 THEN round(ms[floor((len(ms) - 1) * 0.975)::BIGINT + 1], 9) END AS high FROM seen s JOIN o ON o.lang = s.lang""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language, with sources as groups; a null outcome is undecided and in no mean."""
    decided = F.when(F.col("doc_id") % 7 != 0, F.col("quality"))
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").select("lang", "source", decided.alias("value"))
    found = cluster_bootstrap(rows, "source", "value", ["lang"])
    return found.select("lang", "groups", "contributing", "undefined", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


def bootstrap_exact(groups: dict[str, list[float | None]], repetitions: int = 2000, seed: int = 42) -> dict:
    """The interval by the very draws of Python's generator, for the few groups of one report."""
    import random

    names, draw = list(groups), random.Random(seed)
    known = {g: [v for v in vs if v is not None] for g, vs in groups.items()}
    means = []
    for _ in range(repetitions):
        values = [v for g in draw.choices(names, k=len(names)) for v in known[g]] if names else []
        if values:
            means.append(sum(values) / len(values))
    means.sort()
    contributing = sum(map(bool, known.values()))
    pick = lambda q: means[int((len(means) - 1) * q)]
    return {"groups": len(names), "undefined": repetitions - len(means), "interval": [pick(0.025), pick(0.975)] if contributing >= 2 and means else None}
