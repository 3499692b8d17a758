"""Streams that stop and go on."""

import json
import time
from datetime import timedelta

from siftwell.streaming import jobs


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def test_a_resumed_run_loses_and_repeats_nothing(spark, tmp_path):
    done = spark.createDataFrame([("old", ["a"]), ("bare", [])], "bbbs string, articles array<string>")
    row = lambda k, hour=1: {"bbbs": k, "seen": f"2026-01-01T{hour:02}:00:00"}

    def run():
        records = jobs.json_stream(spark, str(tmp_path / "in"), "bbbs string, seen timestamp", 1)
        query = jobs.resumed(records, done, "seen").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
        return sorted(r["bbbs"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(tmp_path / "in", "1.json", [row("x"), row("old"), row("x"), row("bare")])
    put(tmp_path / "in", "2.json", [row("y", 2), row("x", 2)])
    assert run() == ["bare", "x", "y"]
    put(tmp_path / "in", "3.json", [row("y", 3), row("z", 3), row("old", 3)])
    assert run() == ["bare", "x", "y", "z"] and run() == ["bare", "x", "y", "z"]


def collected(stream, checkpoint, rows, **trigger):
    query = stream.writeStream.outputMode(trigger.pop("mode", "update")).option("checkpointLocation", str(checkpoint)).foreachBatch(lambda df, _: rows.extend(df.collect()))
    return query.trigger(**(trigger or {"availableNow": True})).start()


def stopped_after(query, rows, n):
    """Streams by the clock ask for batches without end, so they are stopped, some batches after the rows are there."""
    deadline = time.time() + 60
    while len(rows) < n and time.time() < deadline and query.isActive:
        time.sleep(0.2)
    time.sleep(2)
    query.stop()
    assert query.exception() is None


def test_histories_with_late_repeated_and_expired_turns(spark, tmp_path):
    turn = lambda c, t, x="": {"conv_id": c, "turn": t, "text": x or f"x{t}"}

    def run(idle, expected):
        rows = []
        turns = jobs.json_stream(spark, str(tmp_path / "in"), "conv_id long, turn long, text string", 1)
        stopped_after(collected(jobs.histories(turns, 3, idle), tmp_path / "at", rows, processingTime="500 milliseconds"), rows, expected)
        return sorted((r["conv_id"], r["turns"], r["texts"]) for r in rows)

    idle = timedelta(seconds=12)
    put(tmp_path / "in", "1.json", [turn(1, 5), turn(1, 2), turn(1, 9), turn(1, 7), turn(2, 1), turn(2, None)])
    assert run(idle, 2) == [(1, [5, 7, 9], ["x5", "x7", "x9"]), (2, [1], ["x1"])]
    put(tmp_path / "in", "2.json", [turn(1, 8), turn(1, 9), turn(1, 2), turn(3, None)])  # late, repeated, too late, no turn
    assert run(idle, 1) == [(1, [7, 8, 9], ["x7", "x8", "x9"])]
    time.sleep(12)
    put(tmp_path / "in", "3.json", [turn(1, 4), turn(2, 1, "y")])
    assert run(idle, 2) == [(1, [4], ["x4"]), (2, [1], ["y"])]  # both had been forgotten


def test_silent_sources_by_the_time_of_rows(spark, tmp_path):
    beat = lambda s, minute, state="running": {"source": s, "state": state, "updated_at": f"2026-01-01T10:{minute:02}:00Z"}
    rows = []

    def run():
        beats = jobs.json_stream(spark, str(tmp_path / "in"), "source string, state string, updated_at timestamp", 1)
        collected(jobs.silences(beats, timedelta(minutes=2), "1 minute"), tmp_path / "at", rows, mode="append").awaitTermination(120)
        told = sorted((r["source"], r["updated_at"].minute, r["event"]) for r in rows)
        rows.clear()
        return told

    put(tmp_path / "in", "1.json", [beat("a", 0), beat("b", 0), beat("c", 0), beat("c", 1, "done")])
    assert run() == []
    put(tmp_path / "in", "2.json", [beat("a", 6)])
    assert run() == [("b", 0, "silent")]  # a was heard again, c is done
    put(tmp_path / "in", "3.json", [beat("a", 7), beat("b", 7)])
    assert run() == [("b", 7, "back")]
    put(tmp_path / "in", "4.json", [beat("d", 30)])
    assert run() == [("a", 7, "silent"), ("b", 7, "silent")]
    put(tmp_path / "in", "5.json", [beat("d", 31)])
    assert run() == []  # told once


def test_silent_sources_by_the_clock(spark, tmp_path):
    rows = []
    put(tmp_path / "in", "1.json", [{"source": "a", "state": "running", "updated_at": "2026-01-01T10:00:00Z"}])
    beats = jobs.json_stream(spark, str(tmp_path / "in"), "source string, state string, updated_at timestamp")
    query = collected(jobs.silences(beats, timedelta(seconds=1)), tmp_path / "at", rows, processingTime="500 milliseconds")
    stopped_after(query, rows, 1)
    assert [(r["source"], r["event"]) for r in rows] == [("a", "silent")]


def test_rates_of_sliding_windows(spark, tmp_path):
    put(tmp_path / "in", "1.json", [{"at": f"2026-01-01T10:0{m}:30"} for m in (0, 0, 1, 4)])
    rows = []
    records = jobs.json_stream(spark, str(tmp_path / "in"), "at timestamp")
    collected(jobs.rate_by_window(records, "at", "2 minutes", "1 minute"), tmp_path / "at", rows, mode="complete").awaitTermination(120)
    assert {r["window"]["start"].minute: (r["n"], r["per_minute"]) for r in rows} == {59: (2, 1.0), 0: (3, 1.5), 1: (1, 0.5), 3: (1, 0.5), 4: (1, 0.5)}
