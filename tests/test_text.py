"""Text queries on rows without a text, votes at rounding ties against SQL, and the audit of tables."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.functions import text as X
from barloom.plans.text import rnd
from barloom.sources import landing as L


def test_documents_without_a_text_or_a_word_score_nothing(spark, tmp_path):
    """The walk over no words gives 0 and no names, in every query that reads its scores."""
    docs = [(0, None, 50), (1, None, None), (2, "", 0), (3, "The the not of le, que que to the that", None), (4, "and les on tion", 90), (5, "12", 10)]
    spark.createDataFrame([(i, t, "en", "s", n) for i, t, n in docs], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

    def rows(name):
        return {r[0]: tuple(r)[1:] for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    scores = rows("lexicon_scores")
    assert scores[0] == scores[1] == scores[2] == scores[5] == (0.0, 0.0, "") and scores[4] == (-0.5, 0.0, "BBB,EEE")
    features = rows("sentiment_features")
    assert features[1] == (None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) and features[0][3:] == (0.0, 0.0, 0.0, 0.0) and features[3][1:3] == (0.0, 0.0)
    assert rows("news_sentiment")["*"] == (round((scores[3][0] - 0.5) / 6, 6), 6, 1, 1)
    assert rows("vote_blended_scores")[0] == (0.4,) and rows("vote_blended_scores")[5] == (0.4,)


def test_votes_at_rounding_ties_equal_sql(spark):
    grid = spark.range(-128, 129).select((F.col("id") / 128).alias("s")).crossJoin(spark.range(7).withColumnRenamed("id", "up")).crossJoin(spark.range(5).withColumnRenamed("id", "dn"))
    got = {(r.s, r.up, r.dn): r.b for r in grid.withColumn("b", rnd(X.vote_blend(F.col("s"), F.col("up"), F.col("dn")))).collect()}
    want = duckdb.sql("""SELECT s, up, dn, round(CASE WHEN up + dn > 0 THEN 0.6 * s + 0.4 * (up - dn) / (up + dn) ELSE s END, 6) FROM
      (SELECT (i / 128)::DOUBLE AS s, up, dn FROM range(-128, 129) a(i), range(7) b(up), range(5) c(dn))""").fetchall()
    assert [(s, u, d, b, got[s, u, d]) for s, u, d, b in want if got[s, u, d] != b] == []


def test_a_table_of_many_files_is_audited_as_one(spark, tmp_path):
    root = tmp_path / "data.parquet.d"
    spark.range(8).withColumnRenamed("id", "ts").repartition(3).write.parquet(str(root / "a.parquet"))
    (root / "a.parquet" / "part-x.parquet").write_bytes(b"no")
    spark.range(2).withColumnRenamed("id", "value").repartition(2).write.parquet(str(root / "b.parquet" / "month=1"))
    spark.range(2).withColumnRenamed("id", "ts").toPandas().to_parquet(root / "c.parquet")
    got = sorted(map(tuple, L.audit_tables(spark, str(root), ("ts", "value")).collect()))
    assert got == [("a.parquet", True, "value", False), ("b.parquet", False, "ts", False), ("c.parquet", False, "value", False)]


def test_a_store_that_only_spark_opens_is_audited(spark, tmp_path):
    """All of its files counted as unreadable before."""
    spark.range(8).withColumnRenamed("id", "ts").repartition(2).write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "b.parquet").write_bytes(b"no")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.audit.link./in", f"file://{tmp_path}")
    got = sorted(map(tuple, L.audit_tables(spark, "viewfs://audit/in", ("ts", "value")).collect()))
    assert got == [("a.parquet", False, "value", False), ("b.parquet", True, "", False)]


def test_letters_are_lowered_as_sql_lowers_them(spark):
    texts = ["İn the", "tİon", "ΣΑΣ", "the ΟΔΟΣ le", "laK", "ÉTHE ſ", "THE\x00Le"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: (list(r.toks), r.key) for r in df.select("text", X.tokens(F.col("text")).alias("toks"), X.title_key(F.col("text")).alias("key")).collect()}
    for t in texts:
        assert got[t] == duckdb.execute("SELECT regexp_extract_all(lower($1), '[a-z'']+'), lower($1)", [t]).fetchone()
