"""Exact distinct counts in a stream: over several batches, a restart and late events."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wordtide.streaming.adoption import exact_adoption, read_events, run_to_end, with_open_windows

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def write(spark, rows, folder, name):
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(folder / name))
    [part] = (folder / name).glob("part-*.parquet")
    (folder / "in").mkdir(exist_ok=True)
    part.rename(folder / "in" / f"{name}.parquet")


def day_rows(rng, day, n=40):
    return [(day * 1000 + k, f"2024-01-{day:02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00", rng.choice([None, *range(12)]), rng.choice("ab"), 0.0, "{}") for k in range(n)]


def counts(rows):
    who = defaultdict(set)
    for _, ts, user, kind, _, _ in rows:
        if user is not None:
            who[kind, ts[:10]].add(user)
    return {k: len(v) for k, v in who.items()}


def drain(spark, tmp_path):
    events = read_events(spark, str(tmp_path / "in"), files_a_trigger=1)
    got = run_to_end(exact_adoption(events, ["event_type"]), str(tmp_path / "out"), str(tmp_path / "state"))
    return {(r["event_type"], str(r["start"])[:10]): r["entities"] for r in got.collect()}


def test_batches_and_a_restart_give_the_table_s_counts(spark, tmp_path):
    rng = random.Random(1)
    days = {d: day_rows(rng, d) for d in range(1, 9)}
    days[3] += [(1, "2024-01-02 23:00:00", 99, "a", 0.0, "{}")]  # out of order, but not late
    for d in range(1, 6):
        write(spark, days[d], tmp_path, f"f{d}")
    first = drain(spark, tmp_path)
    for d in range(6, 9):
        write(spark, days[d], tmp_path, f"f{d}")
    got = drain(spark, tmp_path)  # from the same checkpoint
    want = counts([r for rows in days.values() for r in rows])
    closed = {k: v for k, v in want.items() if k[1] <= "2024-01-05"}
    assert got == closed and first.items() <= got.items() and 0 < len(first) < len(got)
    table = spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    every = with_open_windows(out, table, ["event_type"])
    assert {(r["event_type"], str(r["start"])[:10]): r["entities"] for r in every.collect()} == want


def test_late_events_are_dropped_and_no_user_counts_twice(spark, tmp_path):
    one = lambda k, ts, user: (k, ts, user, "a", 0.0, "{}")
    write(spark, [one(1, "2024-01-01 10:00:00", 1), one(2, "2024-01-01 23:00:00", 1)], tmp_path, "f1")
    write(spark, [one(3, "2024-01-09 10:00:00", 1)], tmp_path, "f2")
    write(spark, [one(4, "2024-01-09 11:00:00", 1)], tmp_path, "f3")  # a batch's watermark holds from the next one on
    write(spark, [one(5, "2024-01-01 11:00:00", 2), one(6, "2024-01-20 00:00:00", 1)], tmp_path, "f4")
    assert drain(spark, tmp_path) == {("a", "2024-01-01"): 1, ("a", "2024-01-09"): 1}


def test_a_delay_shorter_than_a_window_is_refused(spark, tmp_path):
    write(spark, day_rows(random.Random(2), 1), tmp_path, "f1")
    with pytest.raises(ValueError):
        exact_adoption(read_events(spark, str(tmp_path / "in")), ["event_type"], late="2 hours")


def test_a_table_that_no_watermark_closes(spark, tmp_path):
    rows = day_rows(random.Random(3), 4)
    write(spark, rows, tmp_path, "f1")
    assert drain(spark, tmp_path) == {}
    table = spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = with_open_windows(spark.read.schema("event_type string, start timestamp, entities long").parquet(str(tmp_path / "out")), table, ["event_type"])
    assert {(r["event_type"], str(r["start"])[:10]): r["entities"] for r in got.collect()} == counts(rows)
