import datetime as dt
import json

from pyspark.sql import functions as F

from pagemill.sources import readers as R
from pagemill.sources import sinks
from pagemill.operators import linkstore
from pagemill.session import is_shared
from pagemill.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def test_url_lists(spark, tmp_path):
    text = tmp_path / "urls.txt"
    text.write_text("https://a.com\n\n  # no\n https://b.com \n#x\n")
    assert [r.url for r in R.urls_from_text(spark, str(text)).collect()] == ["https://a.com", "https://b.com"]
    doc = tmp_path / "urls.json"
    cases = {
        '[{"url": "a"}, "b", {"x": 1}, 5, ["c"], null]': ["a", "b"], '{"url": "a", "x": 2}': ["a"], '{"x": 1}': [], '"b"': [], "[]": [], "{bad": [],
    }
    for content, expected in cases.items():
        doc.write_text(content)
        assert [r.url for r in R.urls_from_json(spark, str(doc)).collect()] == expected, content
    doc.write_text('[{"u": "a"}]')
    assert [r.url for r in R.urls_from_json(spark, str(doc), "u").collect()] == ["a"]


def test_labels(spark, tmp_path):
    path = tmp_path / "labels.jsonl"
    path.write_text(json.dumps({"url": "a", "is_plp": 1}) + "\n\n{broken\n" + json.dumps({"url": "b", "is_plp": 0}) + "\n")
    assert sorted(r.url for r in R.labels_jsonl(spark, str(path)).collect()) == ["a", "b"]


def test_usable_pages_and_cache(spark):
    fetched = spark.createDataFrame(
        [(1, "a", "x", True, None), (2, "b", "", True, None), (3, "c", "x", False, "timeout"), (4, "d", None, None, None)],
        "page_id int, url string, html string, success boolean, error string",
    )
    kept, dropped = R.usable_pages(fetched)
    assert [r.page_id for r in kept.collect()] == [1]
    assert {r.page_id: r.reason for r in dropped.collect()} == {2: "empty", 3: "timeout", 4: "failed"}
    versions = spark.createDataFrame([("a", "1", 1, 1), ("a", "2", 2, 2), ("b", "3", 1, 3)], "url string, html string, fetched_at int, fetch_id int")
    stored = spark.createDataFrame([("a", "0")], "url string, html string")
    assert {r.url: r.html for r in R.cached_or_newest(stored, versions, True).collect()} == {"a": "0", "b": "3"}
    assert {r.url: r.html for r in R.cached_or_newest(stored, versions, False).collect()} == {"a": "2", "b": "3"}


def test_artifact_name(spark):
    rows = spark.createDataFrame([("a.b.c", None, "raw"), ("a.b", "", "raw"), ("a.b", "r1", "cleaned")], "d string, r string, s string")
    names = [r[0] for r in rows.select(sinks.artifact_name(F.col("d"), F.col("r"), F.col("s"))).collect()]
    assert names == ["a_b_c_raw", "a_b_raw", "a_b_r1_cleaned"]


def test_catalog_stream_repeats_safely(spark, tmp_path):
    store = str(tmp_path / "catalog")
    schema = "id bigint, url string, domain_id bigint, link_html string, found_at timestamp_ntz, last_crawled_at timestamp_ntz"
    J.start_catalog(spark, store, spark.createDataFrame([], schema))
    sites = spark.createDataFrame([(1, "a")], "id bigint, name string")
    apply = J.catalog_upsert(store, sites)
    batch = spark.createDataFrame(
        [("found", "a", "u", "h", T0, 1), ("found", "a", "u", "h2", T0, 2), ("crawled", "a", "u", None, T0, 3)],
        "kind string, domain string, url string, link_html string, at timestamp_ntz, seq int",
    )
    apply(batch, 0)
    apply(batch, 0)
    rows = J.catalog_table(spark, store).collect()
    assert [(r.id, r.url, r.link_html, r.last_crawled_at) for r in rows] == [(1, "u", "h", T0)]
    later = T0 + dt.timedelta(days=1)
    more = spark.createDataFrame([("found", "a", "v", "h", T0, 1), ("crawled", "a", "u", None, later, 2)], batch.schema)
    apply(more, 1)
    apply(more, 1)
    rows = J.catalog_table(spark, store).orderBy("id").collect()
    assert [(r.id, r.url, r.last_crawled_at) for r in rows] == [(1, "u", later), (2, "v", None)]
    assert spark.read.parquet(f"{store}/changes/batch=1").count() == 2
    J.compact(spark, store, f"{store}-2")
    assert sorted(J.catalog_table(spark, f"{store}-2").collect()) == sorted(rows)


def test_stream_dedup(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "n int, html string")
    rows.write.parquet(source)
    run = lambda: J.run_now(J.content_dedup(J.read_files(spark, source, rows.schema)), str(tmp_path / "cp"), str(tmp_path / "out"))
    run()
    spark.createDataFrame([(3, "x"), (4, "z")], "n int, html string").write.mode("append").parquet(source)
    run()
    assert sorted(r.html for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y", "z"]


def test_dedup_state_stays_flat_and_no_repeat_is_accepted(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    make = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("n"), F.concat(F.lit("text "), F.col("id") % 2_000).alias("html"))
    sizes, apply = [], J.accept_new(out)
    for k in range(10):
        # Each batch brings 100 new contents and repeats old ones.
        make(100 * k, 100 * k + 100).union(make(0, 100)).coalesce(1).write.mode("append").parquet(source)
        query = J.run_now(J.content_dedup(J.read_files(spark, source, make(0, 1).schema), within="0 seconds"), checkpoint, each=apply)
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    stored = spark.read.parquet(out)
    assert stored.count() == stored.select("content_hash").distinct().count() == 1_000
    assert max(sizes[3:]) <= 400
    # A batch that is run again writes the same rows again.
    again = make(900, 1_000).withColumns({"content_hash": F.md5("html"), "arrived_at": F.current_timestamp()})
    last = stored.agg(F.max("batch")).first()[0]
    apply(again, last)
    assert spark.read.parquet(out).where(F.col("batch") == last).count() == 100 and spark.read.parquet(out).count() == 1_000


def test_a_batch_writes_the_groups_it_changes(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    make = lambda sites: spark.createDataFrame([(f"s{i}", bool(i % 2)) for i in sites], "domain string, is_plp boolean").coalesce(1)
    for sites in (range(50), (1, 2, 3), (3,)):
        make(sites).write.mode("append").parquet(source)
        J.run_now(J.label_stats(J.read_files(spark, source, make((0,)).schema)), checkpoint, mode="update", each=J.log_changes(out))
    log = {r.batch: r["count"] for r in spark.read.parquet(out).groupBy("batch").count().collect()}
    assert log == {0: 50, 1: 3, 2: 1}
    table = {r.domain: r.n_samples for r in J.merged(spark, out, ["domain", "is_plp"]).collect()}
    assert len(table) == 50 and [table[f"s{i}"] for i in range(5)] == [1, 2, 2, 3, 1]
    J.fold(spark, out, ["domain", "is_plp"], f"{out}-2")
    assert sorted(J.merged(spark, f"{out}-2", ["domain", "is_plp"]).collect()) == sorted(J.merged(spark, out, ["domain", "is_plp"]).collect())


def test_scratch_folders_are_shared():
    assert is_shared("/data/warehouse", "local[8]") and is_shared("file:/data/warehouse", "local-cluster[2,1,1024]")
    assert is_shared("hdfs://store/warehouse", "yarn") and is_shared("s3a://bucket/x", "spark://host:7077")
    assert not is_shared("/data/warehouse", "yarn") and not is_shared("file:///data/warehouse", "k8s://https://host")


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    store = str(tmp_path / "links")
    sites = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    many = spark.range(1, 2_001).select(
        "id", F.concat(F.lit("u"), "id").alias("url"), F.lit(1).cast("bigint").alias("domain_id"), F.lit("h").alias("link_html"),
        F.lit(T0).cast("timestamp_ntz").alias("found_at"), F.lit(None).cast("timestamp_ntz").alias("last_crawled_at"),
    )
    linkstore.create(many, store)
    files = lambda: {p.parent.name: p.name for p in (tmp_path / "links").glob("bucket=*/*.parquet")}
    batch = spark.createDataFrame(
        [("found", "b", "u7", "x", T0, 1), ("found", "a", "new", "h", T0, 2), ("found", "b", "new", "h2", T0, 3), ("crawled", "a", "u9", None, T0, 4), ("crawled", "b", "u8", None, T0, 5)],
        "kind string, domain string, url string, link_html string, at timestamp_ntz, seq int",
    )
    before = files()
    J.store_upsert(store, sites)(batch, 0)
    after = files()
    rows = {r.url: r for r in linkstore.read(spark, store).collect()}
    assert len(rows) == 2_001 and (rows["new"].id, rows["new"].domain_id, rows["new"].link_html) == (2_001, 1, "h")
    assert rows["u9"].last_crawled_at == T0 and rows["u8"].last_crawled_at is None and rows["u7"].link_html == "h"
    moved = {b for b in after if after[b] != before.get(b)}
    assert len(before) == linkstore.BUCKETS and moved == {f"bucket={rows[u].bucket}" for u in ("new", "u9")}
    J.store_upsert(store, sites)(batch, 0)
    assert files() == after and linkstore.read(spark, store).count() == 2_001
    empty = linkstore.apply(spark, store, sites, many.limit(0).select(F.lit("a").alias("domain"), "url", "link_html", "found_at", F.lit(0).alias("seq")), spark.createDataFrame([], "domain string, url string, crawled_at timestamp_ntz"), ["seq"])
    assert empty == [] and files() == after
