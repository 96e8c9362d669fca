import zipfile

import pytest
from pyspark.sql import functions as F

from barloom.sources import landing as L


def test_archive_months_with_and_without_header(spark, tmp_path):
    row = "{},1,2,0.5,1.5,10,{},15,3,4,6,0\n"
    for month, head in (("2024-01", ""), ("2024-02", ",".join(L.ARCHIVE_COLUMNS) + "\n")):
        with zipfile.ZipFile(tmp_path / f"AAA-5m-{month}.zip", "w") as z:
            z.writestr("x.csv", head + row.format(1704067200000, 1704067499999) + row.format(1704067500000, 1704067799999))
    rows = L.read_archives(spark, str(tmp_path))
    assert rows.count() == 4
    merged = L.merge_archive(rows).orderBy("open_time").collect()
    assert [(r.symbol, r.interval, r.close, r.trades) for r in merged] == [("AAA", "5m", 1.5, 3)] * 2


def test_feed_items_and_entities(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A &amp;amp; B</title><pubDate>d</pubDate></item><item><title> </title></item></channel></rss>")
    got = L.read_feed(spark, str(tmp_path)).collect()
    assert [(r.title, r.published) for r in got] == [("A & B", "d")]


def test_upsert_replaces_only_touched_months(spark, tmp_path):
    def bars(rows):
        df = spark.createDataFrame(rows, "symbol string, open_time string, close double, ingest_seq long")
        full = df.withColumn("open_time", F.to_timestamp("open_time")).withColumn("interval", F.lit("5m"))
        return full.select(*[F.col(f.name).cast(f.dataType) if f.name in full.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in L.BAR_SCHEMA.fields])
    path, stage = str(tmp_path / "bars"), str(tmp_path / "stage")
    L.write_bars(bars([("a", "2024-01-01", 1.0, 1), ("a", "2024-02-01", 2.0, 2)]), path)
    L.upsert_bars(spark, path, bars([("a", "2024-02-01", 9.0, 1), ("b", "2024-02-02", 3.0, 1)]), stage)
    got = L.read_bars(spark, path).orderBy("symbol", "open_time").collect()
    assert [(r.symbol, r.close) for r in got] == [("a", 1.0), ("a", 9.0), ("b", 3.0)]


def test_audit_reports_broken_and_incomplete_files(spark, tmp_path):
    spark.range(1).withColumnRenamed("id", "open").write.parquet(str(tmp_path / "ok"))
    (tmp_path / "bad.parquet").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[-1]: r for r in L.audit_files(spark, str(tmp_path)).collect()}
    assert got["bad.parquet"].unreadable
    other = next(r for k, r in got.items() if k != "bad.parquet")
    assert "close" in other.missing and not other.too_large


def test_report_table_is_text(spark):
    assert L.markdown_table(spark.sql("select 1 as a, 2.5D as b, cast(null as int) as c")).splitlines()[-1] == "| 1 | 2.50 | n/a |"


def test_cleaned_bars_keep_the_last_ingested(spark):
    from barloom.operators.bars import clean_bars
    rows = spark.createDataFrame([("a", 1, "1.0", 1), ("a", 1, "2.0", 3), ("a", 1, "n/a", 4), ("a", 2, "5", 2)], "symbol string, open_time long, close string, ingest_seq long")
    assert sorted((r.open_time, r.close) for r in clean_bars(rows, ["close"]).collect()) == [(1, 2.0), (2, 5.0)]


def test_a_fold_gives_equal_rows_however_the_stream_is_cut(spark, tmp_path):
    from barloom.streaming import live
    from barloom.streaming.fold import use_rocksdb
    use_rocksdb(spark)
    rows = [("a" if i % 3 else "b", i, i, float(i % 7)) for i in range(60)]
    schema = "symbol string, t long, seq long, value double"

    def replayed(cuts: int) -> list:
        path = str(tmp_path / f"in{cuts}")
        for k in range(cuts):
            part = rows[k * len(rows) // cuts:(k + 1) * len(rows) // cuts]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/f={k:02d}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
        return sorted(map(tuple, live.replay(live.rate_history(stream, 10), "cut").collect()))

    assert replayed(1) == replayed(4) and len(replayed(3)) == len(rows)


def test_a_dataset_is_published_whole_or_not_at_all(spark, tmp_path):
    from barloom.sources import snapshots as N
    path = str(tmp_path / "set")
    assert N.newest(spark, path) is None and N.catalog(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        N.read_table(spark, path, "values")
    values = spark.range(10).selectExpr("'a' AS symbol", "id AS bar_idx", "id AS t")
    events = values.filter("bar_idx = 3")
    first = L.write_event_dataset(values, events, path, 1, "one")

    def state():
        manifest = N.read_table(spark, path, "manifest").first()
        return N.read_table(spark, path, "values").count(), N.read_table(spark, path, "events").count(), manifest["n_values"], manifest["token"]

    assert state() == (10, 1, 10, "one")
    # a writer that dies after the values of the second snapshot, before its events
    broken = events.withColumn("t", F.expr("CAST(raise_error('lost') AS BIGINT)"))
    with pytest.raises(Exception, match="lost"):
        L.write_event_dataset(values.union(values), broken, path, 2, "two")
    assert state() == (10, 1, 10, "one") and N.catalog(spark, path).select("snapshot").distinct().count() == 1
    L.write_event_dataset(values.union(values), events, path, 2, "two")
    assert state() == (20, 1, 20, "two") and N.read_table(spark, path, "values", first).count() == 10
    assert {(r["name"], r["rows"], r["seq"]) for r in N.catalog(spark, path).collect()} == {("values", 10, 1), ("events", 1, 1), ("manifest", 1, 1), ("values", 20, 2), ("events", 1, 2), ("manifest", 1, 2)}
