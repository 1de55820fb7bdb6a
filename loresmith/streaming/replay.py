"""The ledger as a stream: events are replayed by Structured Streaming, with watermarks for late ones.

An extension of ours: the reference reads its ledger at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import ORACLE_SQL, query
from ..operators import ledger
from ..operators.shared import shared_folder, until_exit


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of files; the path may be one file or a folder of them."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(schema).format("parquet").option("maxFilesPerTrigger", 64)
    if spark.read.format("binaryFile").load(path).select("path").limit(2).count() == 1:
        return stream.option("pathGlobFilter", name).load(folder)
    return stream.load(path)


def windowed_spend(events: DataFrame, length: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Spend by window and kind of event; what comes later than ``late`` behind the newest event is left out of closed windows."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Drive a bounded stream to its end; each batch is written below the shared folder by the executors, and the written table is returned."""
    spark = stream.sparkSession
    path = shared_folder(spark, "replay")

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that runs again replaces what it wrote before
        batch.write.mode("overwrite").parquet(f"{path}/table" if mode == "complete" else f"{path}/table/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{until_exit(spark, path)}/table").select(*stream.columns)


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS requests, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL""")
def spend_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_to_table(windowed_spend(event_stream(spark, sf_dir)))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "requests", "cents")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS requests FROM s GROUP BY user_id, k""")
def request_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a user that follow each other within eight hours."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", F.session_window("ts", "8 hours")).agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("requests"))
    return rows.select("user_id", "start", "requests")


def gate(requests: DataFrame, budget: int) -> DataFrame:
    """Admission of requests (user_id, request_id, ts, reserved, cost: null if unknown) as they come, until one would go beyond the user's budget.

    What a user has spent and whether the run has stopped is the state that is
    kept between batches.  Requests of one batch are taken by time; one that
    comes in a later batch than a newer one is taken where it comes.
    """

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spent, stopped = state.get if state.exists else (0, False)
        rows = pd.concat(list(frames)).sort_values(["ts", "request_id"])
        out = []
        for r in rows.itertuples():
            stopped = stopped or spent + r.reserved > budget
            out.append((key[0], r.request_id, spent, not stopped))
            if not stopped:
                spent += int(r.reserved if pd.isna(r.cost) else r.cost)
        state.update((spent, stopped))
        yield pd.DataFrame(out, columns=["user_id", "request_id", "spent_before", "admitted"])

    rows = requests.select("user_id", "request_id", F.col("ts").cast("timestamp").alias("ts"), "reserved", "cost")
    return rows.groupBy("user_id").applyInPandasWithState(admit, "user_id long, request_id long, spent_before long, admitted boolean", "spent long, stopped boolean", "append", "NoTimeout")


def stream_budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value") * 1000).cast("long")
    requests = event_stream(spark, sf_dir).select("user_id", F.col("event_id").alias("request_id"), "ts", (cents + 500 + F.col("event_id") % 7 * 4000).alias("reserved"), F.when(F.col("event_type") != "error", cents).alias("cost"))
    return run_to_table(gate(requests, 200_000), "append")


query(ORACLE_SQL[ledger.budget_gate.__name__])(stream_budget_gate)
