"""Adoption over a stream of events: daily active users, and users of each item, in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files_a_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files with ts as a timestamp, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def item_of(props) -> F.Column:
    return F.get_json_object(props, "$.k")


def daily_adoption(events: DataFrame) -> DataFrame:
    """genre, day, item, entities, active, pct over a finished table: exact distinct counts."""
    rows = events.select(F.col("event_type").alias("genre"), F.to_date("ts").alias("day"), F.col("user_id").alias("entity"), item_of(F.col("props")).alias("item"))
    active = rows.groupBy("genre", "day").agg(F.count_distinct("entity").alias("active"))
    used = rows.where("item is not null").groupBy("genre", "day", "item").agg(F.count_distinct("entity").alias("entities"))
    return used.join(active, ["genre", "day"]).select("genre", "day", "item", "entities", "active", (F.col("entities") * 100.0 / F.col("active")).alias("pct"))


def streaming_adoption(events: DataFrame, late: str = "2 days", width: str = "1 day", error: float = 0.02) -> DataFrame:
    """genre, start, events, entities of closed windows: entities by a mergeable sketch, as exact distinct counts have no bounded state."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, F.col("event_type").alias("genre")).agg(F.count("*").alias("events"), F.approx_count_distinct("user_id", error).alias("entities")).select("genre", F.col("window.start").alias("start"), "events", "entities")


def exact_adoption(events: DataFrame, keys: list[str], late: str = "2 days", width: str = "1 day") -> DataFrame:
    """keys, start, entities of closed windows: exact distinct users of events(keys, ts, user_id), in append mode with bounded state.

    Two stateful operators in a chain. The first lets a user through once a window and keys; it forgets a user `late` behind the event that
    it let through, and as `late` is no shorter than a window, whatever else the user does in that window is dropped as a repeat before, and as
    late after. The second counts what comes through and closes a window when the watermark has passed it. State holds users and windows of
    about `late` + `width`, never all windows. Events later than `late` are dropped."""
    spark = events.sparkSession
    if spark.sql(f"SELECT INTERVAL {late} < INTERVAL {width}").first()[0]:
        raise ValueError(f"late ({late}) must not be shorter than a window ({width})")
    start = F.window("ts", width).start
    marked = events.select(*keys, "ts", "user_id").where("user_id is not null").withWatermark("ts", late).withColumn("_start", start)
    once = marked.dropDuplicatesWithinWatermark([*keys, "_start", "user_id"])
    return once.groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("entities")).select(*keys, F.col("window.start").alias("start"), "entities")


def with_open_windows(closed: DataFrame, events: DataFrame, keys: list[str], width: str = "1 day") -> DataFrame:
    """closed, and the windows that a finished table's stream left open behind its watermark, counted in the table: the last ones of all."""
    last = closed.agg(F.max("start").alias("_last"))
    rows = events.where("user_id is not null").withColumn("start", F.window("ts", width).start).crossJoin(F.broadcast(last))  # one row
    rows = rows.where(F.col("_last").isNull() | (F.col("start") > F.col("_last")))
    return closed.unionByName(rows.groupBy(*keys, "start").agg(F.count_distinct("user_id").alias("entities")))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is there into Parquet, exactly once by the checkpoint, and read it.

    append: windows that the watermark has passed. complete: all windows, also those still open, with late events in; each batch writes
    the whole result over the last one's, and the state holds all windows."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    elif mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    else:
        raise ValueError(f"mode {mode}")
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
