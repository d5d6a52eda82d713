"""Adoption over the stream of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from ..streaming.adoption import daily_adoption, exact_adoption, item_of, read_events, run_to_end, streaming_adoption, with_open_windows
from .registry import query, rounded, table


@query(
    """WITH e AS (SELECT event_type AS genre, CAST(ts AS DATE) AS day, user_id AS entity, json_extract_string(props, '$.k') AS item FROM events),
    a AS (SELECT genre, day, count(DISTINCT entity) AS active FROM e GROUP BY ALL)
    SELECT e.genre, CAST(e.day AS VARCHAR) AS day, item, count(DISTINCT entity) AS entities, any_value(active) AS active, round(100.0 * count(DISTINCT entity) / any_value(active), 4) AS pct
    FROM e JOIN a USING (genre, day) WHERE item IS NOT NULL GROUP BY ALL"""
)
def events_daily_adoption(spark, d):
    return rounded(daily_adoption(table(spark, d, "events")), "pct").withColumn("day", F.col("day").cast("string"))


@query()
def stream_daily_adoption(spark, d):
    """The same in event time, drained from a file stream: every day's events and a sketch of their users. The table is finished, so the
    mode is complete: no day stays open behind the watermark and no event is dropped as late."""
    import uuid

    root = shared_folder(spark)
    folder = f"{root.rstrip('/')}/wordtide-stream/{uuid.uuid4().hex}"
    events = read_events(spark, f"{d}/events.parque[t]")  # a pattern, since a stream reads folders
    return run_to_end(streaming_adoption(events), f"{folder}/out", f"{folder}/state", "complete").withColumn("start", F.col("start").cast("string"))


@query("SELECT event_type AS genre, json_extract_string(props, '$.k') AS item, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS entities FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL")
def stream_exact_adoption(spark, d):
    """Exact daily users of every item from a file stream in append mode; the last days, which no watermark passes, from the table."""
    import uuid

    keys = ["genre", "item"]
    shape = lambda e: e.select(F.col("event_type").alias("genre"), item_of(F.col("props")).alias("item"), F.col("ts").cast("timestamp").alias("ts"), "user_id").where("item is not null")
    folder = f"{shared_folder(spark)}/wordtide-stream/{uuid.uuid4().hex}"
    stream = exact_adoption(shape(read_events(spark, f"{d}/events.parque[t]")), keys)
    closed = run_to_end(stream, f"{folder}/out", f"{folder}/state")
    out = with_open_windows(closed, shape(table(spark, d, "events")), keys)
    return out.select("genre", "item", F.to_date("start").cast("string").alias("day"), "entities")
