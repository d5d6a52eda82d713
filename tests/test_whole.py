"""Queries over finished tables read all of them."""

import duckdb
from pyspark.sql import functions as F

from wordtide.plans import QUERIES, SQL
from wordtide.plans.texts import account_filter_whole, provenance_key


def test_stream_leaves_no_day_open(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = str(tmp_path / "events.parquet")
    src.coalesce(1).write.parquet(str(tmp_path / "e"))
    [file] = (tmp_path / "e").glob("part-*.parquet")
    file.rename(out)
    got = QUERIES["stream_daily_adoption"](spark, str(tmp_path))
    assert got.agg(F.sum("events")).first()[0] == src.count()
    want = {(r["event_type"], str(r["day"])): r["count"] for r in src.groupBy("event_type", F.to_date("ts").alias("day")).count().collect()}
    assert {(r["genre"], r["start"][:10]): r["events"] for r in got.collect()} == want


def test_late_files_count_in_complete_mode(spark, tmp_path):
    from wordtide.streaming.adoption import read_events, run_to_end, streaming_adoption

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartitionByRange(4, F.desc("ts")).write.parquet(str(tmp_path / "e"))
    stream = streaming_adoption(read_events(spark, str(tmp_path / "e"), files_a_trigger=1))
    assert run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"), "complete").agg(F.sum("events")).first()[0] == src.count()


def test_accounts_are_told_by_whole_texts(spark, tmp_path):
    texts = ["x " * 40 + "in", "x" * 37 + " in between", "In bloom", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["not_account"] for r in account_filter_whole(spark, str(tmp_path)).orderBy("doc_id").collect()] == [False, True, False, True]


def test_rows_of_many_files_have_records_of_their_own(spark, tmp_path):
    """Files in the order of their names, as in SQL: 2 after 10, a blank before a sign that sorts behind it, a plus as it is; one is empty."""
    docs = duckdb.read_parquet("/root/testdata/sf0.001/documents.parquet")  # noqa: F841  read by name
    (tmp_path / "documents.parquet").mkdir()
    for k, name in enumerate(["part-2", "part-10", "part 3", "part!4", "part+5", "part,6", "part-7%20"]):
        duckdb.sql(f"SELECT doc_id FROM docs WHERE doc_id % 8 = {k} AND {k} <> 5 ORDER BY doc_id DESC").write_parquet(str(tmp_path / "documents.parquet" / f"{name}.parquet"))
    documents = duckdb.read_parquet(str(tmp_path / "documents.parquet" / "*.parquet"))  # noqa: F841
    got = provenance_key(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(SQL["provenance_key"]).fetchall())
    assert len({r["record"] for r in got}) == len(got) > 100
