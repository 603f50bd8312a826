"""Page records, menus and requests."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagewright.operators import records
from pagewright.plans import record_queries
from pagewright.plans.session import scratch_path
from pagewright.streaming import requests


def test_page_record_of_odd_pages(spark):
    rows = [(1, "https://a.example/x", "https://a.example/login", '<title> T </title><meta name="Description" content="d"><a href="../y">y</a><a href="">e</a>'), (2, "https://a.example/", "https://a.example/", None), (3, "no url", "no url", "<h1>x</h1>")]
    got = {r["page_id"]: r for r in records.page_records(spark.createDataFrame(rows, "page_id int, url string, final_url string, html string")).collect()}
    assert (got[1]["title"], got[1]["meta_description"], got[1]["internal_links"], got[1]["redirected_to_login"], got[1]["warnings"]) == ("T", "d", ["https://a.example/y"], True, ["missing_headings"])
    assert (got[2]["status"], got[2]["title"], got[2]["warnings"]) == ("failed", None, [])
    assert got[3]["headings"][0]["text"] == "x"


def test_guarded_links(spark):
    rows = spark.createDataFrame([("/u/7?x",), ("/u",), ("https://a.example/admin",), ("/adminx",), ("",)], "href string")
    guarded = F.array(F.lit("/u/:id"), F.lit("/admin"))
    assert [r[0] for r in rows.select(records.requires_auth(F.col("href"), guarded)).collect()] == [True, False, True, False, False]


def test_request_stream_equals_batch(spark):
    t = datetime(2024, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    first = [("a", at(0), "ask"), ("b", at(1), "ask"), ("c", at(2), "ask"), ("d", at(3), "ask"), ("d", at(4), "reply")]
    second = [("a", at(30), "reply"), ("b", at(400), "reply"), ("z", at(5), "reply")]
    last = [("end", at(4000), "ask")]
    path, kind = scratch_path(spark, "requests"), "id string, ts timestamp, kind string"
    for rows in (first, second, last):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    query = requests.track(stream).writeStream.outputMode("append").format("memory").queryName("tracked").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["id"]: (r["outcome"], r["replied"]) for r in spark.table("tracked").collect()}
    batch = {r["id"]: (r["outcome"], r["replied"]) for r in requests.outcomes(spark.createDataFrame(first + second + last, kind)).collect()}
    assert batch == {"a": ("answered", at(30)), "b": ("timed_out", None), "c": ("timed_out", None), "d": ("answered", at(4)), "z": ("unasked", None), "end": ("pending", None)}
    assert {k: v for k, v in got.items() if v[0] != "pending"} == {k: v for k, v in batch.items() if v[0] in ("answered", "timed_out")}


def test_event_outcomes_take_every_event(spark, tmp_path):
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    rows = [(0, at(0), "view"), (1, at(1), "view"), (2, at(0), "view"), (3, at(1), "view"), (4, at(0), "view"), (5, at(1), "error"), (6, at(0), "error"), (7, at(9), None), (9, at(9), "view"), (13, at(1), "error")]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in record_queries.event_outcomes(spark, str(tmp_path)).collect()}
    assert got == {("0", "answered"), ("1", "answered"), ("2", "timed_out"), ("3", "timed_out"), ("4", "unasked"), ("6", "unasked")}
