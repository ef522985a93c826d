"""Leases by the clock, and the audit of a log as a stream."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from evidentia.plans import workflow
from evidentia.streaming import events

BEATS = "node string, attempt long, kind string, ts timestamp"
LOG = "node string, state string, ts timestamp, event_id long"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("".join(json.dumps(r) + "\n" for r in rows))
    at = time.time() - 100 + int(name[0])  # files are read in the order of their times
    os.utime(folder / f".{name}", (at, at))
    (folder / f".{name}").rename(folder / name)  # whole at once


def test_a_silent_stream_lets_leases_run_out(spark, tmp_path):
    beat = lambda node, kind="beat", attempt=1: {"node": node, "attempt": attempt, "kind": kind, "ts": "2024-01-01T00:00:00"}
    put(tmp_path / "in", "1.json", [beat("a"), beat("b"), beat("b", "end"), beat("c"), beat("c", attempt=2)])
    rows = events.lapsed(events.read_log(spark, str(tmp_path / "in"), BEATS), 2)
    run = rows.writeStream.format("memory").queryName("lapsed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        found, until = [], time.time() + 60
        while len(found) < 3 and time.time() < until:  # no file comes any more
            time.sleep(0.5)
            found = sorted((r.node, r.attempt) for r in spark.table("lapsed").collect())
        assert found == [("a", 1), ("c", 1), ("c", 2)]
        time.sleep(3)
        assert spark.table("lapsed").count() == 3  # once each
    finally:
        run.stop()


def test_audit_of_a_stream_equals_that_of_the_table(spark, tmp_path):
    rng = random.Random(5)
    states = sorted({a for a in workflow.NODE_TRANSITIONS} | {b for bs in workflow.NODE_TRANSITIONS.values() for b in bs})
    log = [{"node": f"n{rng.randrange(6)}", "state": rng.choice(states), "ts": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}", "event_id": i} for i in range(240)]
    for k in range(4):  # each file is out of order within a minute
        part = log[k * 60 : k * 60 + 60]
        rng.shuffle(part)
        put(tmp_path / "in", f"{k}.json", part)
    put(tmp_path / "in", "9.json", [{"node": "end", "state": "PENDING", "ts": "2024-01-01T09:00:00", "event_id": 999}])
    rows = events.audited(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), "2 minutes")
    run = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    table = spark.read.schema(LOG).json(str(tmp_path / "in"))
    want = workflow.violations(table, workflow.transitions_table(spark), "node", "state", "ts", "event_id")
    expected = {(r.node, r.before, r.after, r.event_id) for r in want.collect()}
    got = [(r.node, r.before, r.after, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert set(got) == expected and len(got) == len(expected) > 50


def test_late_events_are_left_out(spark, tmp_path):
    row = lambda state, ts, i: {"node": "n", "state": state, "ts": ts, "event_id": i}
    put(tmp_path / "in", "1.json", [row("PENDING", "2024-01-01T00:00:00", 1), row("SUCCEEDED", "2024-01-01T01:00:00", 2)])
    put(tmp_path / "in", "2.json", [row("READY", "2024-01-01T00:30:00", 3), row("PENDING", "2024-01-01T02:00:00", 4)])
    rows = events.audited(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in")))
    run = rows.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert "READY" not in {x for r in spark.table("late").select(F.col("before"), F.col("after")).collect() for x in r}
