"""Streams, command line and the driver's entry."""

import json
import os

import pytest

from pagestrata import cli
from pagestrata.operators.collection import Collection
from pagestrata.operators.embed import HashedNgrams
from pagestrata.streaming.ingest import document_stream, ingest_stream, once_each, windowed_counts

DATA = "/root/testdata/sf0.001"


def test_stream_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    doc = {"html": "<p>Hello there</p>", "url": "https://a.example/", "ingested_at": "2024-01-01T00:00:00Z"}
    (source / "a.json").write_text(json.dumps(doc) + "\n" + json.dumps(doc) + "\n")
    target = Collection(spark, "stream", str(tmp_path / "db"))
    for _ in range(2):  # the second run finds nothing new
        query = ingest_stream(once_each(document_stream(spark, str(source))), target, str(tmp_path / "ckpt"), embedder=HashedNgrams(8))
        query.awaitTermination(120)
        assert query.exception() is None
    assert [r["text"] for r in target.rows().collect()] == ["Hello there"]


def test_windows(spark):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")]
    df = spark.createDataFrame(rows, "t string, k string").selectExpr("cast(t as timestamp) as t", "k")
    assert sorted((r["k"], r["count"]) for r in windowed_counts(df, "t", ["k"]).collect()) == [("a", 2), ("b", 1)]


def test_command_line(spark, tmp_path, capsys):
    page = tmp_path / "p.html"
    page.write_text("<p>Hello world</p>")
    base = ["--directory", str(tmp_path / "db"), "--collection", "c"]
    assert cli.main([*base, "process", str(page)], spark) == 0
    assert cli.main([*base, "batch", str(tmp_path)], spark) == 0
    capsys.readouterr()
    assert cli.main([*base, "search", "Hello", "--format", "json", "--where", '{"element_type": "paragraph"}'], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["text"] == "Hello world"
    assert cli.main([*base, "stats"], spark) == 0 and cli.main([*base, "export", str(tmp_path / "o.json")], spark) == 0
    assert cli.main([*base, "config", "--save", str(tmp_path / "c.json")]) == 0
    assert cli.main([*base, "process", str(tmp_path / "none.html")], spark) == 1
    assert cli.main([*base, "reset", "--yes"], spark) == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["crawl_job", "timestamp", "url_key", "change"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
