"""Operators on small tables, against brute force where there is more than one way."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagestrata.config import PipelineConfig, SearchConfig, SnapshotConfig, choose_config, load_config, preset, save_config
from pagestrata.errors import ConfigError, EmbedError, PageError, ValidationError, error_of, guarded
from pagestrata.functions.validate import Query, collection_name, validated
from pagestrata.operators import stats
from pagestrata.operators.collection import Collection, above, nearest
from pagestrata.operators.embed import HashedNgrams
from pagestrata.operators.snapshot_diff import snapshot_changes, snapshot_index
from pagestrata.operators.where import compile_where
from pagestrata.plans.metrics import Metrics, Profiler
from pagestrata.plans.pipeline import Pipeline
from pagestrata.sources import snapshots

META = "meta_id bigint, crawl_job bigint, timestamp string, original_url string, content_length bigint, links_found int, images_found int, processed_at double"
VALUES = ["content_length", "links_found", "images_found"]


def brute_changes(rows):
    best, order = {}, {}
    for m, job, ts, url, c, li, im, p in rows:
        if url is None or ts is None or len(ts) != 14 or not ts.isdigit() or not 1 <= int(ts[4:6]) <= 12:
            continue
        rank = (p if p is not None else float("-inf"), m)
        key = (job, ts, url)
        if key not in best or rank > best[key][0]:
            best[key] = (rank, (c, li, im))
        order.setdefault(job, set()).add(ts)
    out = []
    for job, seen in order.items():
        seen = sorted(seen)
        for a, b in zip(seen, seen[1:]):
            before = {u: v[1] for (j, t, u), v in best.items() if (j, t) == (job, a)}
            after = {u: v[1] for (j, t, u), v in best.items() if (j, t) == (job, b)}
            out += [(job, b, u, "added") for u in after.keys() - before.keys()] + [(job, b, u, "removed") for u in before.keys() - after.keys()]
            out += [(job, b, u, "changed") for u in after.keys() & before.keys() if after[u] != before[u]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_snapshot_changes_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = []
    for m in range(400):
        ts = rng.choice([f"2020{rng.randint(1, 4):02d}{rng.randint(1, 2):02d}0{rng.randint(0, 3)}0000", "20201301000000", "x", None, "2020010100000"] if rng.random() < 0.1 else [f"2020{rng.randint(1, 4):02d}{rng.randint(1, 2):02d}0{rng.randint(0, 3)}0000"])
        rows.append((m, rng.choice([1, 1, 1, 2, None]), ts, rng.choice(["a/x", "a/y", "a/z", None]), rng.choice([None, 1, 2]), rng.choice([None, 5]), rng.choice([None, 5]), rng.choice([None, 1.0, 2.0])))
    rows += rows[:20]  # repeated deliveries
    df = spark.createDataFrame(rows, META)
    got = sorted((tuple(r) for r in snapshot_changes(df, VALUES, block).collect()), key=repr)
    assert got == brute_changes(rows)


def test_snapshot_changes_empty_and_extra_columns(spark):
    assert snapshot_changes(spark.createDataFrame([], META), VALUES).count() == 0
    rows = [(1, 1, "20200101000000", "http://a.b/x", 1, 1, 1, 1.0), (2, 1, "20200102000000", "http://a.b/y", 1, 1, 1, 1.0)]
    clash = spark.createDataFrame(rows, META).withColumn("key", F.lit("k")).withColumn("idx", F.lit(9)).withColumn("job", F.lit(7))
    assert sorted(tuple(r) for r in snapshot_changes(clash, VALUES).collect()) == [(1, "20200102000000", "a.b/x", "removed"), (1, "20200102000000", "a.b/y", "added")]


def test_snapshot_null_place_matters(spark):
    rows = [(1, 1, "20200101000000", "a/x", 5, None, 1, 1.0), (2, 1, "20200102000000", "a/x", None, 5, 1, 1.0), (3, 1, "20200103000000", "a/x", None, 5, 1, 1.0)]
    assert [tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, META), VALUES).collect()] == [(1, "20200102000000", "a/x", "changed")]


def test_snapshot_index_is_dense(spark):
    stamps = [f"20200{m}{d:02d}000000" for m in (1, 2) for d in range(1, 6)]
    df = spark.createDataFrame([(1, t, "k") for t in stamps for _ in range(2)], "job int, ts string, key string")
    got = {r["ts"]: (r["idx"], r["next_ts"]) for r in snapshot_index(df).collect()}
    assert got == {t: (i + 1, stamps[i + 1] if i + 1 < len(stamps) else None) for i, t in enumerate(stamps)}


def test_nearest_and_plan(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([(1, 0), (0, 1), (-1, 0), (1, 0)])]
    df = spark.createDataFrame([*rows, (9, None), (10, [1.0])], "id int, embedding array<float>")
    got = nearest(df, [1.0, 0.0], 3).collect()
    assert [(r["id"], r["similarity_score"]) for r in got] == [(0, 1.0), (3, 1.0), (1, -1.0)]
    hits = above(nearest(df, [1.0, 0.0], 3), 0.5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and plan.index("Filter") < plan.index("TakeOrderedAndProject")
    assert hits.count() == 2 and above(nearest(df, [1.0, 0.0], 3), -0.5).count() == 3


def test_where(spark):
    df = spark.createDataFrame([("1", {"a": "x", "n": "5"}), ("2", {"a": "y"}), ("3", {})], "id string, metadata map<string,string>")
    ids = lambda w: sorted(r["id"] for r in (df.filter(compile_where(w)) if compile_where(w) is not None else df).collect())
    assert ids({"a": "x"}) == ["1"] and ids({}) == ["1", "2", "3"] and ids({"a": {"$ne": "x"}}) == ["2", "3"]
    assert ids({"n": 5}) == ["1"] and ids({"n": {"$gt": 4}}) == ["1"] and ids({"a": {"$in": ["x", "y"]}}) == ["1", "2"] and ids({"a": {"$nin": ["x"]}}) == ["2", "3"]
    assert ids({"$or": [{"a": "y"}, {"n": "5"}]}) == ["1", "2"] and ids({"$and": [{"a": "x"}, {"n": "5"}]}) == ["1"] and ids({"a": "x", "n": "6"}) == []
    with pytest.raises(ValidationError):
        compile_where({"a": {"$like": "x"}})


PAGES = [
    {"html": "<html><body><h1>Політична партія</h1><p>" + "Слово про громаду. " * 60 + "</p></body></html>", "url": "https://a.example/1", "wayback_metadata": {"timestamp": "20201130051600", "original_url": "https://a.example/1", "domain": "a.example"}},
    {"html": "<p>Hello world</p><ul><li>Item one</li></ul>", "url": "plain"},
    {"html": "no tags", "url": "https://a.example/3"},
    {"html": "<p>x</p>", "url": "https://a.example/4"},
]


def test_pipeline_end_to_end(spark, tmp_path):
    pipe = Pipeline(spark, PipelineConfig(persist_directory=str(tmp_path)), HashedNgrams(32))
    got = {r["document_index"]: r for r in pipe.process_documents(PAGES).collect()}
    assert [got[i]["success"] for i in range(4)] == [True, True, False, False]
    assert got[0]["chunked_blocks_count"] > got[0]["text_blocks_count"] == 2 and got[1]["url"] == "document://plain"
    assert got[2]["error"] == "no HTML tags found" and got[3]["error"] == "No text blocks extracted" and got[0]["embedding_dimension"] == 32
    stored = pipe.collection.rows()
    assert stored.count() == got[0]["chunked_blocks_count"] + 2
    meta = [r["metadata"] for r in pipe.search_by_metadata({"element_type": "list_item"}).collect()]
    assert len(meta) == 1 and meta[0]["hierarchy_level"] == "" and "wayback_domain" not in meta[0] and "chunk_index" not in meta[0]
    hits = pipe.search("Hello world", 2).collect()
    assert hits[0]["text"] == "Hello world" and abs(hits[0]["similarity_score"] - 1) < 1e-5
    assert {r["metadata"]["wayback_domain"] for r in pipe.search_snapshots("партія", 3, domain="a.example", year=2020).collect()} == {"a.example"}
    assert pipe.search_snapshots("партія", 3, year=2019).count() == 0
    info = pipe.database_stats()
    assert info["domains"] == 2 and info["top_domains"]["a.example"] > 0
    for form in ("json", "csv"):
        pipe.export(str(tmp_path / f"out.{form}"), form)
    assert len(json.loads((tmp_path / "out.json").read_text())) == stored.count()
    assert (tmp_path / "out.csv").read_text().startswith("text,")
    with pytest.raises(PageError):
        pipe.export(str(tmp_path / "x"), "xml")
    with pytest.raises(ValidationError):
        pipe.process_documents(PAGES, strict=True)
    with pytest.raises(ValidationError):
        pipe.process_documents([])
    pipe.reset()
    assert pipe.collection.rows().count() == 0 and pipe.stats()["metrics"]["counters"]["documents"] == 4


def test_collection_update(spark, tmp_path):
    pipe = Pipeline(spark, PipelineConfig(persist_directory=str(tmp_path)), HashedNgrams(8))
    pipe.process_documents(PAGES[1:2])
    rows = pipe.collection.rows()
    before = {r["id"]: r["text"] for r in rows.collect()}
    pipe.collection.update(rows.filter("text = 'Hello world'").withColumn("text", F.lit("Changed")))
    after = {r["id"]: r["text"] for r in pipe.collection.rows().collect()}
    assert after.keys() == before.keys() and sorted(after.values()) == ["Changed", "Item one"]
    pipe.process_documents(PAGES[1:2])
    assert pipe.collection.rows().count() == 4  # appends do not deduplicate
    again = Collection(spark, pipe.collection.name, str(tmp_path))
    assert again.stats()["document_count"] == 4
    again.drop()


def write_snapshots(root):
    day = root / "20201130051600"
    day.mkdir()
    (day / "a-b.com_.html").write_text("<p>Перша сторінка</p>", encoding="utf-8")
    (day / "a-b.com_.html.meta.json").write_text(json.dumps({"original_url": "https://a-b.com/", "timestamp": "20201130051600", "title": "T", "content_length": 500}), encoding="utf-8")
    (day / "lone.htm").write_bytes("<p>café</p>".encode("latin-1"))
    (day / "gone.html.meta.json").write_text("{}", encoding="utf-8")
    (day / "blank.html").write_text("  \n")
    (day / "broken.html").write_text("<p>x</p>")
    (day / "broken.html.meta.json").write_text("{not json")


def test_snapshot_sources(spark, tmp_path):
    write_snapshots(tmp_path)
    report = snapshots.directory_report(spark, str(tmp_path))
    assert (report["total_html_files"], report["total_meta_files"], report["paired_files"], report["is_valid"]) == (4, 3, 2, True)
    assert report["orphaned_html_files"] == ["blank.html", "lone.htm"] and report["orphaned_meta_files"] == ["gone.html"]
    paired = snapshots.snapshots(spark, str(tmp_path), require_metadata=True).collect()
    assert [(r["url"], r["wayback_metadata"]["domain"], r["content_length"]) for r in paired] == [("https://a-b.com/", "a-b.com", 500)]
    derived = {r["path"].rsplit("/", 1)[1]: r for r in snapshots.snapshots(spark, str(tmp_path)).collect()}
    assert derived["a-b.com_.html"]["wayback_metadata"]["domain"] == "a.b.com" and derived["lone.htm"]["html"] == "<p>café</p>"
    assert derived["lone.htm"]["url"] == "unknown_url_lone" and "blank.html" not in derived
    fixed = snapshots.snapshots(spark, str(tmp_path), fixed_domain=True)
    assert snapshots.filtered(fixed, domains=["a-b.com"]).count() == 1 and snapshots.filtered(fixed, years=[2019]).count() == 0
    assert snapshots.filtered(fixed, least_length=15).count() == 1
    with pytest.raises(FileNotFoundError):
        snapshots.snapshots(spark, str(tmp_path / "none"))
    assert not snapshots.directory_report(spark, str(tmp_path / "none"))["is_valid"]
    assert snapshots.glob_files(spark, str(tmp_path / "20201130051600")).count() == 3


def test_snapshot_pipeline(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_snapshots(tmp_path / "in")
    pipe = Pipeline(spark, PipelineConfig(persist_directory=str(tmp_path / "db")), HashedNgrams(8))
    got = pipe.process_snapshots(str(tmp_path / "in"), require_metadata=True).collect()
    assert len(got) == 1 and got[0]["success"] and got[0]["wayback_processed"]
    assert pipe.browse(domain="a-b.com").count() == 1 and pipe.browse(year=2020).count() == 1


def test_path_metadata(spark):
    df = spark.createDataFrame([("20201130051600/sub-host.com_about_ideology_.html",), ("x/2015/page.txt.html",), ("plain/file",)], "p string")
    got = [r[0] for r in df.select(snapshots.path_metadata(F.col("p"))).collect()]
    assert (got[0]["domain"], got[0]["original_url"], got[0]["year"]) == ("sub-host.com", "https://sub-host.com/about/ideology", 2020)
    assert got[1]["timestamp"] == "20150101000000" and got[2]["domain"] == "unknown.com" and got[2]["year"] == 2020


def test_stats(spark):
    res = spark.createDataFrame([(True, 100, 50, 4, 5), (False, None, None, 0, 0)], "success boolean, original_html_length long, cleaned_html_length long, text_blocks_count long, chunked_blocks_count long")
    assert stats.batch_summary(res).first()["success_rate"] == 0.5
    assert stats.corpus_stats(res).first()["compression_ratio"] == 0.5
    assert stats.batch_summary(res.limit(0)).first()["success_rate"] == 0
    assert stats.processing_stats(res, F.col("success")).first()["success_rate"] == 50.0


def test_validation(spark):
    docs = spark.createDataFrame([("<p>a</p>", "u", None), (None, "u", None), ("<p>a</p>", None, None)], "html string, url string, wayback_metadata struct<timestamp:string,original_url:string,archive_url:string,domain:string,title:string>")
    assert [r["error"] is None for r in validated(docs).collect()] == [True, False, False]
    for bad in ("", " ", "x", "y" * 1001):
        with pytest.raises(ValidationError):
            Query(bad)
    with pytest.raises(ValidationError):
        Query("fine", 101)
    with pytest.raises(ValidationError):
        collection_name("a b")


def test_config(tmp_path, monkeypatch):
    assert preset("wayback").prefer_basic_cleaning and preset("performance").max_chunk_size == 1024
    with pytest.raises(ValueError):
        preset("none")
    monkeypatch.setenv("RAG_MAX_CHUNK_SIZE", "256")
    monkeypatch.setenv("WAYBACK_YEAR_FILTERS", "2019,2020")
    assert load_config().max_chunk_size == 256 and SnapshotConfig.from_env().year_filters == (2019, 2020)
    path = str(tmp_path / "c.json")
    save_config(choose_config("english", max_chunk_size=100, unknown=1), path)
    assert load_config(path).max_chunk_size == 100 and preset("english").max_chunk_size == 512
    with pytest.raises(ConfigError):
        PipelineConfig(max_chunk_size=10)
    with pytest.raises(ConfigError):
        SearchConfig(default_n_results=0)


def test_errors_and_metrics(tmp_path):
    assert isinstance(error_of("embed", "x"), EmbedError) and type(error_of("?", "x")) is PageError

    @guarded("embed")
    def fails():
        raise KeyError("k")

    with pytest.raises(EmbedError):
        fails()
    m = Metrics()
    with m.stage("a"):
        m.count("documents", 2)
    m.save(str(tmp_path / "m.json"))
    assert Metrics.load(str(tmp_path / "m.json")).summary()["success_rate"] == 1.0
    p = Profiler()
    p.timed(lambda: 1)()
    assert p.summaries()["<lambda>"]["calls"] == 1


def test_embedder_is_deterministic_and_unit():
    e = HashedNgrams(64)
    v = e.encode(["Слово про громаду", "", "😀"])
    assert (v == e.encode(["Слово про громаду", "", "😀"])).all() and abs((v[0] ** 2).sum() - 1) < 1e-5 and not v[1].any()


def stored_rows(spark, ids, text):
    from pagestrata.schemas import STORED

    return spark.createDataFrame([tuple(i if f.name == "id" else text if f.name == "text" else None for f in STORED.fields) for i in ids], STORED)


def test_updates_cost_their_own_rows_and_the_latest_wins(spark, tmp_path):
    held = Collection(spark, "parts", "file://" + str(tmp_path))
    held._add_part(stored_rows(spark, [f"i{n}" for n in range(300)], "old"), False)
    first = held.store.size(held._data() + "/part-0")
    for k in range(3):
        held.update(stored_rows(spark, ["i1", f"new{k}"], f"text {k}"))
    assert held.store.size(held._data() + "/part-0") == first and held.store.size(held._data() + "/part-3") < first
    got = {r["id"]: r["text"] for r in held.rows().collect()}
    assert len(got) == 303 and held.rows().count() == 303 and got["i1"] == "text 2" and got["i2"] == "old" and got["new0"] == "text 0"
    held._add_part(stored_rows(spark, ["i1"], "added later"), False)  # an append replaces nothing
    assert sorted(r["text"] for r in held.rows().filter("id = 'i1'").collect()) == ["added later", "text 2"]
    held.compact()
    assert held.rows().count() == 304 and held.vacuum() == ["v1"] and held.rows().count() == 304
    held.reset()
    assert held.rows().count() == 0
    held.drop()
    assert not held.store.exists(held.path)


def test_many_small_parts_are_compacted(spark, tmp_path):
    held = Collection(spark, "many", str(tmp_path))
    held.MANY = 3
    for k in range(6):
        held.update(stored_rows(spark, [f"i{k}", "same"], f"text {k}"))
    assert held._state()["version"] > 1 and held.rows().count() == 7
    assert [r["text"] for r in held.rows().filter("id = 'same'").collect()] == ["text 5"]


def test_a_pruner_changes_only_short_pages_of_the_ai_route(spark):
    class Shouting:
        """A pruner that keeps one paragraph; it fails on pages that ask for it."""

        def prune(self, pages):
            if any("FAIL" in p for p in pages):
                raise ValueError("no")
            return ["<p>pruned page</p>" for _ in pages]

    from pagestrata.config import PipelineConfig
    from pagestrata.plans.pipeline import block_rows, parsed_pages

    pages = [("a", "<p>plain english page</p>"), ("b", "<p>" + "long english page " * 400 + "</p>"), ("c", "<p>українська сторінка про громаду</p>")]
    texts = lambda rows, pruner: {r["url"]: r["text"][:12] for r in block_rows(parsed_pages(spark.createDataFrame(rows, "url string, html string"), PipelineConfig(), pruner=pruner)).collect()}
    assert texts(pages, Shouting()) == {"document://a": "pruned page", "document://b": "long english", "document://c": "українська с"}
    assert texts(pages, None)["document://a"] == "plain englis"
    assert texts([("a", "<p>FAIL to prune</p>")], Shouting()) == {"document://a": "FAIL to prun"}


def test_settings_choose_models(spark, tmp_path):
    from pagestrata.errors import ModelError, SearchError
    from pagestrata.plans.pipeline import Pipeline

    with pytest.raises(ModelError):
        Pipeline(spark, persist_directory=str(tmp_path), embedding_model="none such")
    with pytest.raises(ModelError):
        Pipeline(spark, persist_directory=str(tmp_path), html_pruner_model="none such")
    pipe = Pipeline(spark, persist_directory=str(tmp_path))
    with pytest.raises(SearchError):
        pipe.search_ukrainian("громада села")
    pipe.process_documents([{"html": "<p>громада нашого села</p>", "url": "u"}, {"html": "<p>our english village</p>", "url": "e"}])
    assert [r["text"] for r in pipe.search_ukrainian("громада села").collect()] == ["громада нашого села"]
    assert pipe.search("громада села").count() == 2


def test_scans_are_counted_and_titled(spark, tmp_path):
    folder = tmp_path / "20200101000000"
    folder.mkdir()
    (folder / "a-b.com_x.html").write_text("<html><head><title> A &amp; B </title></head><p>hello</p></html>")
    (folder / "a-b.com_x.html.meta.json").write_text('{"original_url": "https://a-b.com/x"}')
    (folder / "c.com_y.html").write_text("  ")
    (folder / "d.com_z.html").write_text("<p>z</p>")
    (folder / "d.com_z.html.meta.json").write_text("{broken")
    html, meta = snapshots.html_files(spark, str(tmp_path)), snapshots.meta_files(spark, str(tmp_path))
    got = snapshots.scan_counts(html, meta).first().asDict()
    assert got == {"total": 3, "processed": 1, "errors": 2, "blank_pages": 1, "broken_metadata": 1, "without_metadata": 1, "success_rate": pytest.approx(100 / 3)}
    assert snapshots.scan_counts(html).first()["processed"] == 2
    titles = {r["path"].rsplit("/", 1)[1]: r["wayback_metadata"]["title"] for r in snapshots.snapshots(spark, str(tmp_path)).collect()}
    assert titles == {"a-b.com_x.html": "A & B", "d.com_z.html": "Unknown Title"}
    assert {tuple(r) for r in snapshots.orphan_names(html.select("key"), meta.select("key")).collect()} == {("c.com_y.html", "html")}


def test_throughput(spark):
    rows = spark.createDataFrame([(1_000_000,), (None,)], "original_html_length long")
    assert stats.throughput(rows, 4.0).first().asDict() == {"documents": 2, "html_mb": 1.0, "documents_per_second": 0.5, "seconds_per_document": 2.0}
    assert stats.throughput(rows.limit(0), 0.0).first()["documents_per_second"] == 0.0


def test_public_names_benchmark_and_sampler():
    import time

    import pagestrata
    from pagestrata.plans.metrics import Metrics, Sampler, benchmark

    assert all(getattr(pagestrata, n) is not None for n in pagestrata.__all__) and pagestrata.get_info()["embedders"] == ["hashed-ngrams"]
    with pytest.raises(AttributeError):
        pagestrata.nothing_of_the_kind  # noqa: B018
    calls = []
    got = benchmark(calls.append, 3, 2, "x")
    assert len(calls) == 5 and got["runs"] == 3 and 0 <= got["least"] <= got["median"] <= got["greatest"]
    with Sampler(0.01) as sampler:
        time.sleep(0.05)
    assert len(sampler.samples) >= 3 and sampler.summary()["seconds"] > 0 and Sampler().summary()["peak_memory_mb"] == 0
    metrics = Metrics()
    metrics.count("documents", 4)
    assert metrics.summary()["seconds_per_document"] > 0
