"""The activity log as a stream: daily counts, rolling limits and admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..core.session import checkpoint_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table read as a file stream."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that is available, as a table in the shared checkpoint folder, where the query's state lies too.

    Each micro-batch overwrites a folder of its own, so one that is repeated after a failure adds nothing;
    in complete mode the last one is the result. Nothing passes through the driver.
    """
    spark = stream.sparkSession
    at = f"{checkpoint_dir(spark)}/{name}"
    last = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        last.append(number)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{at}/out/batch={max(last)}" if mode == "complete" else f"{at}/out").select(*stream.columns)


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, event_type, n) per day of event time, rows later than `late` dropped on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


#: Failed attempts of one user and of all users within WINDOW seconds that are borne, and what each one beyond the latter delays (fixed values).
MOST_OF_USER, MOST_OF_ALL, WINDOW, DELAY, MOST_DELAY = 10, 60, 900, 0.25, 2.0


def _with_context(events: DataFrame, seconds: int) -> DataFrame:
    """`events` with bucket (of `seconds`) and own: each row stands in its own bucket and, as context, in the next one."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    b = F.floor(us / (seconds * 1_000_000))
    return events.withColumn("_us", us).withColumn("_x", F.explode(F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), F.struct((b + 1).alias("b"), F.lit(False).alias("own"))))).select("*", F.col("_x.b").alias("_b"), F.col("_x.own").alias("_own")).drop("_x")


def rolling(events: DataFrame, seconds: int = WINDOW, success: Column | None = None) -> DataFrame:
    """Each event with `recent`, the number of its user's events in the `seconds` up to it; after a `success` the count starts anew.

    A user's events are cut into buckets of `seconds`, each with the one before as context, so even one user
    who holds a third of all events is shared out over many tasks.
    """
    e = _with_context(events.withColumn("_ok", F.coalesce(success, F.lit(False)) if success is not None else F.lit(False)), seconds)
    e = e.withColumn("_since", F.coalesce(F.sum(F.col("_ok").cast("int")).over(W.partitionBy("user_id", "_b").orderBy("_us", "event_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    n = F.count("*").over(W.partitionBy("user_id", "_b", "_since").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0))
    return e.withColumn("recent", n).where("_own").drop("_us", "_b", "_own", "_ok", "_since")


def delayed(events: DataFrame, seconds: int = WINDOW) -> DataFrame:
    """Each event with `delay`, the seconds it waits for what all users did in the `seconds` up to it."""
    e = _with_context(events, seconds)
    n = F.count("*").over(W.partitionBy("_b").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0))
    return e.withColumn("delay", F.least(F.lit(MOST_DELAY), F.greatest(F.lit(0.0), (n - MOST_OF_ALL) * DELAY))).where("_own").drop("_us", "_b", "_own")


def admitted(events: DataFrame, calls: int, seconds: float, late: str = "1 day") -> DataFrame:
    """(event_id, user_id, admitted) on a stream: at most `calls` admitted events of a user in any `seconds`.

    A micro-batch's events of a user are judged in order of time, then event_id; only their times and ids are
    held, and the source's batch size bounds these. State is the times of the last admitted events, `calls`
    at most; it ends when the watermark, `late` behind the events, has passed the last one by `seconds`.
    Events later than that are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        seen = pd.concat([b[["ts", "event_id"]] for b in batches], ignore_index=True).sort_values(["ts", "event_id"])
        times = seen["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        ok = []
        for now in times.tolist():
            hits = [h for h in hits if h > now - seconds]
            ok.append(len(hits) < calls)
            if ok[-1]:
                hits.append(now)
        state.update((hits,))
        state.setTimeoutTimestamp(max(int((max([*hits, times[-1]]) + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": seen["event_id"].to_numpy(), "user_id": key[0], "admitted": ok})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "event_id bigint, user_id bigint, admitted boolean", "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def backfill(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What of `rows` is not in `done` yet; run again after a stop, it goes on where it stopped."""
    return rows.join(done.select(key), key, "left_anti")


def apply_batches(stream: DataFrame, name: str, target: str, key: str, work) -> None:
    """Runs `work` over each micro-batch's rows that `target` lacks and appends the result, so a repeated batch adds nothing."""
    spark = stream.sparkSession

    def one(batch: DataFrame, _: int) -> None:
        try:
            known = spark.read.parquet(target)
        except Exception as e:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = batch.limit(0)
        work(backfill(batch.dropDuplicates([key]), known, key)).write.mode("append").parquet(target)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint_dir(spark)}/{name}").trigger(availableNow=True).start().awaitTermination()
