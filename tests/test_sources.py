import json

from pyspark.sql import functions as F

from gleaner.functions import dates, text
from gleaner.sources import readers, writers


def test_subtitles(spark):
    vtt = "WEBVTT\n\n00:00:00.000 --> 00:00:01.500\nHello\n\n00:01.500 --> 00:00:03.000\nwide <b>world</b>\n"
    files = spark.createDataFrame([("a", vtt)], "path string, text string")
    assert [(r.start, r.end, r.text) for r in readers.vtt_segments(files).orderBy("seq").collect()] == [(0.0, 1.5, "Hello"), (1.5, 3.0, "wide world")]
    j3 = json.dumps({"events": [{"tStartMs": 0, "dDurationMs": 1500, "segs": [{"utf8": "Hello "}, {"utf8": "world"}]}, {"tStartMs": 9}]})
    assert [(r.end, r.text) for r in readers.json3_segments(spark.createDataFrame([("a", j3)], "path string, text string")).collect()] == [(1.5, "Hello world")]
    body = json.dumps({"body": [{"from": 0, "to": 1.5, "content": "a"}, {"from": 1.5, "to": 2, "content": " "}]})
    assert [(r.start, r.end, r.text) for r in readers.body_segments(spark.createDataFrame([("a", body)], "path string, text string")).collect()] == [(0.0, 1.5, "a")]


def test_pushes(spark, tmp_path):
    page = {"page": 0, "cursor": None, "pushes": [{"type": "link", "url": "https://example.com", "title": "t", "modified": 10}, {"type": "note", "body": "check https://foo.com here", "modified": 20}, {"type": "note", "body": "none", "modified": 30}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    items = readers.items_of(readers.push_pages(spark, str(tmp_path / "p.json"))).orderBy("place").collect()
    assert [(r.url, r.timestamp) for r in items] == [("https://example.com", 10.0), ("https://foo.com", 20.0)]


def test_json_lines_and_archive(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"url": "a", "timestamp": 1714521600}\n\nbroken\n{"url": "b", "timestamp": 0}\n')
    rows = readers.json_lines(spark, str(tmp_path / "in.jsonl"), "url string, timestamp double")
    assert {r.url for r in rows.collect()} == {"a", "b"}
    writers.month_archive(rows, str(tmp_path / "out"), F.lit("2024-06-01").cast("timestamp"))
    assert (tmp_path / "out/year=2024/year_month=2024-05").exists() and (tmp_path / "out/year=2024/year_month=2024-06").exists()


def test_text(spark):
    row = spark.createDataFrame([("Title\nbody\n#tag one\nmore\n#tag two\n2024-01-02", "Title", ["a", "好的", "好的", "ok ", "\x01x"])], "c string, t string, tags array<string>")
    got = row.select(text.clean_content("c", "t").alias("c"), text.clean_tags("tags").alias("tags"), text.clean_date(F.lit("on 05-06")).alias("d"), text.safe_name(F.lit(' a/b:  c　')).alias("n"), text.clock(F.lit(3661.5)).alias("k")).first()
    assert got.c == "body\nmore\n#tag two" and got.tags == ["好的", "ok"] and got.d == "2025-05-06" and got.n == "a_b_ c" and got.k == "01:01:01"


def test_months_run_over(spark):
    at = F.lit("2024-04-30 10:00:00").cast("timestamp")
    assert str(spark.range(1).select(dates.add_months(at, -2)).first()[0]) == "2024-03-01 10:00:00"
