"""Streams against the batch forms of the same decisions."""

import json

from reachbase.operators import alerts
from reachbase.streaming import alerting

EVENTS = "alert string, seq long, at timestamp, digest string, ends boolean, enabled boolean"


def drained(spark, frames, start, name, folder):
    """Runs a stream over one file for each frame, a micro-batch for each, and returns what it wrote."""
    for k, rows in enumerate(frames):
        (folder / "in").mkdir(exist_ok=True)
        (folder / "in" / f"{k:03}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    query = start(folder / "in").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_streamed_alerts_decide_as_in_batch(spark, tmp_path):
    rows = []
    for k in range(60):
        alert = f"a{k % 3}"
        rows.append({"alert": alert, "seq": k, "at": f"2024-01-01T{k // 6:02}:{k % 6 * 10:02}:00Z", "digest": f"d{k * 7 % 11 // 4}", "ends": k % 13 == 5, "enabled": k % 11 != 7})
    for seq, minute, digest in ((60, 1, "one"), (61, 5, "two"), (62, 9, "three")):
        rows.append({"alert": "b", "seq": seq, "at": f"2024-01-01T09:{minute:02}:00Z", "digest": digest, "ends": False, "enabled": True})
    batch = spark.createDataFrame([(r["alert"], r["seq"], r["at"], r["digest"], r["ends"], r["enabled"]) for r in rows], EVENTS.replace("timestamp", "string")).selectExpr("alert", "seq", "cast(at as timestamp) as at", "digest", "ends", "enabled")
    want = {(r["alert"], r["seq"], r["transition"], r["folds"]) for r in alerts.decide(batch, 3600).collect()}
    frames = [rows[:20], rows[20:35], rows[35:], [{"alert": "other", "seq": 99, "at": "2024-01-03T00:00:00Z", "digest": "x", "ends": False, "enabled": True}]]
    frames.append([{"alert": "other", "seq": 100, "at": "2024-01-04T00:00:00Z", "digest": "y", "ends": False, "enabled": True}])
    read = lambda folder: alerting.decisions(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(folder)), 3600, "10 minutes")
    got = drained(spark, frames, read, "decided", tmp_path)
    assert {(r["alert"], r["seq"], r["transition"], r["folds"]) for r in got if r["alert"] != "other" and r["seq"] is not None} == want
    timers = [r for r in got if r["transition"] == "cooldown_over"]
    assert ("b", 2) in {(r["alert"], r["folds"]) for r in timers} and all(r["folds"] >= 1 and r["seq"] is None for r in timers)


def test_completion_closes_a_run(spark, tmp_path):
    kinds = "run_id string, kind string, batch_id string, readings long, mark long, expected int, claimed string, arrival long"
    batch = lambda run, name, mark, at: {"run_id": run, "kind": "batch", "batch_id": name, "readings": 10, "mark": mark, "expected": None, "claimed": None, "arrival": at}
    done = lambda run, expected, claimed, at: {"run_id": run, "kind": "completion", "batch_id": None, "readings": None, "mark": None, "expected": expected, "claimed": claimed, "arrival": at}
    frames = [
        [batch("r1", "b1", 1, 1), batch("r1", "b1", 1, 2), batch("r2", "b1", 5, 3)],
        [done("r1", 2, "succeeded", 4), batch("r2", "b2", 4, 5), done("r2", 1, "succeeded", 6)],
        [batch("r1", "b2", 2, 7), done("r1", 2, "succeeded", 8), done("r3", 3, "failed", 9)],
    ]
    read = lambda folder: alerting.runs(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).json(str(folder)))
    got = drained(spark, frames, read, "followed", tmp_path)
    of = lambda run: [(r["event"], r["status"], r["batches"]) for r in got if r["run_id"] == run]
    assert of("r1") == [("batch", "running", 1), ("repeated", "running", 1), ("completed", "partial", 1), ("late_batch", "succeeded", 2), ("repeated", "succeeded", 2)]
    assert of("r2") == [("batch", "running", 1), ("refused", "running", 1), ("completed", "succeeded", 1)]
    assert of("r3") == [("completed", "failed", 0)]
