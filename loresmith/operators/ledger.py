"""Requests, what they cost, and when to stop.  ``events`` stand in for the ledger: ``value`` is a cost in cents, ``error`` a failed request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query, table
from .prefix import running_sums

# Fixed value: bytes put on top of a request's text when its cost is reserved.
OVERHEAD_BYTES = 2048


def reservation(text: Column, input_rate: float, cap: int, output_rate: float) -> Column:
    """What a request may cost at most, in dollars: its bytes and the overhead as tokens, and the full output."""
    return ((F.octet_length(text) + OVERHEAD_BYTES) * input_rate + cap * output_rate) / 1e6


def actual_cost(tokens: Column, cached: Column, output: Column, input_rate: float, cached_rate: float, output_rate: float, created: Column | None = None, created_rate: float = 0.0) -> Column:
    """Dollars for the tokens used, those read from and those written to a cache at rates of their own; null if any count is unknown, never zero."""
    written = F.lit(0) if created is None else created
    return ((tokens - cached - written) * input_rate + cached * cached_rate + written * created_rate + output * output_rate) / 1e6


def with_results(requests: DataFrame, results: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Requests (id, ``reserved`` and more) with ``cost`` and ``status`` of their result (id, cost, status); both null for one that has none.

    A result of no request and a second result of one are refused, since either
    would change what has been spent.
    """
    wrong = results.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).join(requests.select(id_col, F.lit(True).alias("__sent")).distinct(), id_col, "left").where("__n > 1 OR __sent IS NULL")
    if bad := wrong.first():
        raise ValueError(f"a result of no request, or more than one result: {bad[id_col]!r}")
    return requests.join(results.select(id_col, "cost", F.col("status")), id_col, "left")


def spent(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """By keys: ``spent`` (costs, and the reservation where there is no cost) and how many costs are ``unknown``."""
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(F.coalesce("cost", "reserved")), F.lit(0)).alias("spent"), F.count_if(F.col("cost").isNull()).alias("unknown"))


def totals(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """By keys the total of each column; a total with an unknown part is unknown, that of no rows is 0."""
    total = lambda c: F.when(F.count(F.lit(1)) == F.count(c), F.coalesce(F.sum(c), F.lit(0)))
    return rows.groupBy(*keys).agg(*(total(c).alias(c) for c in columns))


def admitted(rows: DataFrame, keys: Sequence[str], order: Sequence[str], budget: int, part: Column | None = None) -> DataFrame:
    """``rows`` with ``spent_before`` and ``admitted``: requests go out in order until one would go beyond the budget; there the run stops.

    The first that is refused and all after it spend nothing, so what they see
    as spent is what had been spent at the stop.
    """
    told = running_sums(rows, keys, order, {"__before": F.coalesce("cost", "reserved")}, part, inclusive=False)
    refused = (F.col("__before") + F.col("reserved") > budget).cast("int")
    stopped = running_sums(told.withColumn("__refused", refused), keys, order, {"__stops": F.col("__refused")}, part)
    # what was spent at a key's first refusal; costs are not below 0, so no refusal before it saw more
    at_stop = stopped.where("__refused = 1").groupBy(*keys).agg(F.min("__before").alias("__at"))
    joined = stopped.alias("r").join(at_stop.alias("s"), [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "left")
    ok = F.col("__stops") == 0
    return joined.select(*(F.col(f"r.{c}") for c in rows.columns), F.when(ok, F.col("__before")).otherwise(F.col("__at")).alias("spent_before"), ok.alias("admitted"))


def failure_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, most: int = 3, part: Column | None = None) -> DataFrame:
    """By keys the ``longest`` run of failures in a row (a success resets it) and how many runs reach ``most`` and so would ``stop``."""
    bad = F.coalesce(failed, F.lit(False))
    told = running_sums(rows.withColumn("__failed", bad), keys, order, {"__run": (~bad).cast("int")}, part)
    runs = told.groupBy(*keys, "__run").agg(F.count_if("__failed").alias("__streak"))
    return runs.groupBy(*keys).agg(F.max("__streak").alias("longest"), F.count_if(F.col("__streak") >= most).alias("stops"))


def firing_order(rows: DataFrame, keys: Sequence[str], due: str, position: str) -> DataFrame:
    """``rows`` with ``fires``: the place by due day, those due together in the order of the list; a day is numbered alone."""
    within = F.row_number().over(Window.partitionBy(*keys, due).orderBy(position))
    days = rows.groupBy(*keys, due).agg(F.count(F.lit(1)).alias("__n"))
    before = days.select(*keys, due, F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(due).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = rows.withColumn("__k", within).alias("r").join(before.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, due)])
    return out.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("r.__k") + F.col("b.__before")).cast("long").alias("fires"))


# Fixed value: what is told of a request that was sent and whose outcome nobody knows.
INTERRUPTED = "Interrupted request; outcome unknown; not retried"


def resumed(plan: DataFrame, requests: DataFrame, results: DataFrame, id_col: str = "request_id") -> DataFrame:
    """(id, state, error) of a plan that is taken up again: ``done`` with a result, ``failed`` where a request went out and none came back (it is never sent again), else ``to send``."""
    sent = requests.select(id_col, F.lit(True).alias("__sent")).distinct()
    back = results.select(id_col, F.lit(True).alias("__back")).distinct()
    joined = plan.select(id_col).join(sent, id_col, "left").join(back, id_col, "left")
    state = F.when(F.col("__back"), "done").when(F.col("__sent"), "failed").otherwise("to send")
    return joined.select(id_col, state.alias("state"), F.when(state == "failed", INTERRUPTED).alias("error"))


@query("""SELECT doc_id, round((octet_length(encode(text)) + 2048) * 0.25 / 1e6 + 1024 * 2.0 / 1e6, 9) AS reserved FROM documents""")
def cost_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(reservation(F.col("text"), 0.25, 1024, 2.0), 9).alias("reserved"))


@query("""SELECT doc_id, round(CASE WHEN doc_id % 6 = 0 THEN NULL ELSE ((n_chars - n_chars // 10 - n_chars // 20) * 2.0 + (n_chars // 10) * 0.2 + (n_chars // 20) * 2.5 + 200 * 10.0) / 1e6 END, 9) AS cost FROM documents""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    tokens = F.when(F.col("doc_id") % 6 != 0, n)
    cached = F.floor(tokens / 10)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(actual_cost(tokens, cached, F.lit(200), 2.0, 0.2, 10.0, F.floor(tokens / 20), 2.5), 9).alias("cost"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their reservation in thousandths of a cent, and joined to them the cost of those that came back, as whole numbers."""
    cents = F.round(F.col("value") * 1000).cast("long")
    events = table(spark, sf_dir, "events")
    # a request's margin hangs on its id, so that a reservation is not a cost plus a constant
    sent = events.select(F.col("event_id").alias("request_id"), "user_id", "ts", "event_type", (cents + 500 + F.col("event_id") % 7 * 4000).alias("reserved"))
    back = events.where("event_type <> 'error'").select(F.col("event_id").alias("request_id"), cents.alias("cost"), F.lit("ok").alias("status"))
    return with_results(sent, back)


_REQUESTS = """SELECT e.event_id AS request_id, e.user_id, e.ts, e.event_type, round(e.value * 1000)::BIGINT + 500 + e.event_id % 7 * 4000 AS reserved, r.cost
    FROM events e LEFT JOIN (SELECT event_id, round(value * 1000)::BIGINT AS cost FROM events WHERE event_type <> 'error') r ON r.event_id = e.event_id"""


def _day() -> Column:
    return F.to_date("ts")



@query(f"SELECT user_id, sum(coalesce(cost, reserved))::BIGINT AS spent, count(*) FILTER (cost IS NULL) AS unknown FROM ({_REQUESTS}) GROUP BY user_id")
def ledger_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request without a result keeps its reservation."""
    return spent(_requests(spark, sf_dir), ["user_id"])


@query(f"SELECT user_id, event_type, CASE WHEN count(*) = count(cost) THEN sum(cost)::BIGINT END AS cost FROM ({_REQUESTS}) GROUP BY user_id, event_type")
def request_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total with an unknown part is unknown."""
    return totals(_requests(spark, sf_dir), ["user_id", "event_type"], ["cost"])


@query(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) AS k FROM ({_REQUESTS})),
    w AS (SELECT user_id, k, request_id, 0::BIGINT AS spent_before, reserved <= 200000 AS admitted, CASE WHEN reserved <= 200000 THEN coalesce(cost, reserved) ELSE 0 END AS spends FROM r WHERE k = 1
      UNION ALL SELECT r.user_id, r.k, r.request_id, w.spent_before + w.spends, w.admitted AND w.spent_before + w.spends + r.reserved <= 200000,
        CASE WHEN w.admitted AND w.spent_before + w.spends + r.reserved <= 200000 THEN coalesce(r.cost, r.reserved) ELSE 0 END FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1)
    SELECT user_id, request_id, spent_before, admitted FROM w""")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests go out while what is spent and their reservation fit the budget; the first that does not ends the run."""
    return admitted(_requests(spark, sf_dir), ["user_id"], ["ts", "request_id"], 200_000, _day()).select("user_id", "request_id", "spent_before", "admitted")


@query("""WITH m AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
    s AS (SELECT user_id, run, count(*) FILTER (failed) AS streak FROM m GROUP BY user_id, run)
    SELECT user_id, max(streak) AS longest, count(*) FILTER (streak >= 3) AS stops FROM s GROUP BY user_id""")
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row, reset by a success; three stop the run."""
    return failure_runs(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", part=_day())


@query(f"""SELECT event_id AS request_id, CASE WHEN event_type = 'error' AND value > 20 THEN 'failed' WHEN event_type = 'error' THEN 'to send' ELSE 'done' END AS state,
    CASE WHEN event_type = 'error' AND value > 20 THEN '{INTERRUPTED}' END AS error FROM events""")
def resume_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events are the plan, errors of little value never went out, and errors have no result."""
    events = table(spark, sf_dir, "events").withColumnRenamed("event_id", "request_id")
    return resumed(events, events.where("event_type <> 'error' OR value > 20"), events.where("event_type <> 'error'"))


@query("""WITH q AS (SELECT event_id, user_id, ts, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS delay, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS day FROM events)
    SELECT user_id, event_id, day + delay AS due, row_number() OVER (PARTITION BY user_id ORDER BY day + delay, day) AS fires FROM q""")
def event_due_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled events fire by their due day, those due together in the order of the list."""
    delay = F.get_json_object("props", "$.k").cast("long")
    listed = running_sums(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", delay.alias("delay")), ["user_id"], ["ts", "event_id"], {"day": F.lit(1)}, _day())
    rows = listed.select("user_id", "event_id", F.col("day").cast("long").alias("day"), (F.col("day") + F.col("delay")).cast("long").alias("due"))
    return firing_order(rows, ["user_id"], "due", "day").drop("day")
