"""The workflow event log as a stream, and leases that run out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Appended JSON lines of a folder as a stream."""
    return spark.readStream.schema(schema).json(folder)


def latest_status(events: DataFrame, node: str = "node", status: str = "status", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """The last status of each node; works on streams (update or complete mode) and tables alike. Events later than the watermark are left out of streams."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(node).agg(F.max_by(status, at).alias(status), F.max(at).alias(at), F.count("*").alias("n_events"))


def status_counts(events: DataFrame, width: str, status: str = "status", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events per tumbling window and status, closed by the watermark in append mode."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width), status).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), status, "n")


def expired_leases(beats: DataFrame, lease: float, now: str) -> DataFrame:
    """(node, attempt, last) of tasks without a beat for ``lease`` seconds before ``now``, whose last event does not end them. beats: (node, attempt, kind, ts); kinds beat and end."""
    last = beats.groupBy("node", "attempt").agg(F.max("ts").alias("last"), F.bool_or(F.col("kind") == "end").alias("_ended"))
    limit = F.unix_micros(F.to_timestamp(F.lit(now))) - int(lease * 1_000_000)
    return last.where(~F.col("_ended") & (F.unix_micros(F.col("last").cast("timestamp")) < limit)).drop("_ended")


def interrupted(beats: DataFrame, lease: float, late: str = "0 seconds") -> DataFrame:
    """The same of a stream: a row (node, attempt, last) when a task's lease runs out in event time, once, unless it has ended. The state of a task goes with it."""
    step = int(lease * 1000)

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        empty = pd.DataFrame({"node": pd.Series(dtype="str"), "attempt": pd.Series(dtype="int64"), "last": pd.Series(dtype="datetime64[us]")})
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"node": [key[0]], "attempt": [key[1]], "last": [pd.Timestamp(last, unit="us")]})
            return
        last, ended = state.get[0] if state.exists else -1, False
        for pdf in batches:
            last = max(last, int(pdf["ts"].astype("datetime64[us]").astype("int64").max()))
            ended |= bool((pdf["kind"] == "end").any())
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + step, state.getCurrentWatermarkMs() + 1))
        yield empty

    rows = beats.withWatermark("ts", late).groupBy("node", "attempt")
    return rows.applyInPandasWithState(watch, "node string, attempt long, last timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def lapsed(beats: DataFrame, lease: float) -> DataFrame:
    """(node, attempt, last) when no beat of a task has come for ``lease`` seconds by the clock, once, unless it has ended.

    The clock runs on while no event comes, so leases also run out when all workers stop. ``last`` is the time of the
    last beat as it says itself. A beat that comes after that starts a lease of its own.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"node": [key[0]], "attempt": [key[1]], "last": [pd.Timestamp(last, unit="us")]})
            return
        last, ended = state.get[0] if state.exists else -1, False
        for pdf in batches:
            last = max(last, int(pdf["ts"].astype("datetime64[us]").astype("int64").max()))
            ended |= bool((pdf["kind"] == "end").any())
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update((last,))
            state.setTimeoutDuration(max(1, int(lease * 1000)))
        yield pd.DataFrame({"node": pd.Series(dtype="str"), "attempt": pd.Series(dtype="int64"), "last": pd.Series(dtype="datetime64[us]")})

    schema = "node string, attempt long, last timestamp"
    return beats.groupBy("node", "attempt").applyInPandasWithState(watch, schema, "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def audited(log: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(node, before, after, ts, event_id) of the steps of a log's nodes whose pair of states is not allowed, as the stream goes on.

    log: a stream of (node, state, ts, event_id). Events are judged in the order of time and id, whatever order they come
    in: each waits until the watermark passes it. Those that come when it has passed them are left out. A node's state
    is its last status and the events that wait. ``workflow.violations`` gives the same rows of a table.
    """
    from ..plans.workflow import allowed

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        waiting, passed = [tuple(x) for x in waiting], state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for pdf in batches:
                fresh = zip(pdf["ts"].astype("datetime64[us]").astype("int64").tolist(), pdf["event_id"].tolist(), pdf["state"].tolist())
                waiting += [x for x in fresh if x[0] > passed]
        waiting.sort(key=lambda x: x[:2])
        found = []
        while waiting and waiting[0][0] <= passed:
            ts, event, status = waiting.pop(0)
            if last is not None and not allowed(last, status):
                found.append((key[0], last, status, pd.Timestamp(ts, unit="us"), event))
            last = status
        state.update((last, waiting))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(found, columns=["node", "before", "after", "ts", "event_id"])
        yield out.astype({"node": "str", "before": "str", "after": "str", "ts": "datetime64[us]", "event_id": "int64"})

    schema = "node string, before string, after string, ts timestamp, event_id long"
    waiting = "last string, waiting array<struct<ts: long, event_id: long, state: string>>"
    return log.withWatermark("ts", late).groupBy("node").applyInPandasWithState(judge, schema, waiting, "append", GroupStateTimeout.EventTimeTimeout)
