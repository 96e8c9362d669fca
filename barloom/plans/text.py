"""News scoring on documents and conversations.

The prose is invented, so the lexicon is made of words that occur in it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import text as X
from barloom.operators import joins as J
from barloom.operators import monitor as M
from barloom.plans.inputs import table
from barloom.plans.registry import query

# Stand-in lexicon.
POSITIVE = ("the", "le", "der", "el")
NEGATIVE = ("and", "et", "und", "los")
UNCERTAIN = ("in", "en", "que")
NEGATION = ("of", "de", "nicht")
INTENSE = ("to", "un", "sch")
TICKERS = {"that": "AAA", "les": "BBB", "ein": "CCC", "que": "DDD", "on": "EEE"}


def rnd(col, digits: int = 6):
    """Rounded as SQL rounds a double, after the multiplication: scores are often fractions that end in a 5 there."""
    c, scale = F.col(col) if isinstance(col, str) else col, float(10**digits)
    return F.round(c * scale) / scale


def scored(spark, d):
    t = table(spark, d, "documents").withColumn("toks", X.tokens(F.col("text")))
    s = X.lexicon_score(F.col("toks"), POSITIVE, NEGATIVE, UNCERTAIN, NEGATION, INTENSE, TICKERS)
    return t.withColumn("_s", s).select("doc_id", "lang", "source", "n_chars", "text", F.col("_s.score.sentiment").alias("sentiment"), F.col("_s.score.uncertainty").alias("uncertainty"), F.col("_s.tickers").alias("tickers"))


def _in(words, t="t"):
    return f"{t} IN ({', '.join(repr(w) for w in words)})"


# The fold as last-consumer logic: a word sees the flags raised since the last plain word.
SCORE_SQL = f"""tk AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents)),
fl AS (SELECT *, {_in(NEGATION)} AS neg, {_in(INTENSE)} AND NOT {_in(NEGATION)} AS amp FROM tk),
pw AS (SELECT *, max(CASE WHEN NOT neg AND NOT amp THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastw, max(CASE WHEN neg THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ln,
   max(CASE WHEN amp THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la FROM fl),
wd AS (SELECT doc_id, n, t, coalesce(ln, 0) > coalesce(lastw, 0) AS inv, CASE WHEN coalesce(la, 0) > coalesce(lastw, 0) THEN 1.5::DOUBLE ELSE 1.0 END AS m FROM pw WHERE NOT neg AND NOT amp),
sm AS (SELECT doc_id, coalesce(sum(CASE WHEN {_in(POSITIVE)} THEN CASE WHEN inv THEN 0 ELSE m END WHEN {_in(NEGATIVE)} THEN CASE WHEN inv THEN m * 0.5 ELSE 0 END ELSE 0 END), 0) AS pos, coalesce(sum(CASE WHEN {_in(POSITIVE)} THEN CASE WHEN inv THEN m ELSE 0 END WHEN {_in(NEGATIVE)} THEN CASE WHEN inv THEN 0 ELSE m END ELSE 0 END), 0) AS ng,
   count(*) FILTER (WHERE {_in(UNCERTAIN)}) AS unc, list_sort(list(DISTINCT CASE t {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TICKERS.items())} END) FILTER (WHERE {_in(TICKERS)})) AS tickers FROM wd GROUP BY doc_id),
nt AS (SELECT doc_id, max(n) AS n FROM tk GROUP BY doc_id),
sc AS MATERIALIZED (SELECT d.doc_id, d.source, d.text, d.n_chars, coalesce(greatest(-1.0, least(1.0, (coalesce(pos, 0) - coalesce(ng, 0)) / sqrt(n))), 0)::DOUBLE AS sentiment, coalesce(unc / sqrt(n), 0)::DOUBLE AS uncertainty, coalesce(tickers, []) AS tickers FROM documents d LEFT JOIN sm USING (doc_id) LEFT JOIN nt USING (doc_id))"""


@query("lexicon_scores", "F01", f"WITH {SCORE_SQL} SELECT doc_id, round(sentiment, 6) AS sentiment, round(uncertainty, 6) AS uncertainty, array_to_string(tickers, ',') AS tickers FROM sc")
def _(spark, d):
    return scored(spark, d).select("doc_id", rnd("sentiment").alias("sentiment"), rnd("uncertainty").alias("uncertainty"), F.array_join("tickers", ",").alias("tickers"))


@query("vote_blended_scores", "F02 K14", f"""WITH {SCORE_SQL}, u AS (SELECT arg_min(doc_id, doc_id) AS doc_id FROM documents GROUP BY lower(text)), v AS (SELECT doc_id, n_chars % 7 AS up, doc_id % 5 AS dn FROM documents)
SELECT doc_id, round(CASE WHEN up + dn > 0 THEN 0.6 * sentiment + 0.4 * (up - dn) / (up + dn) ELSE sentiment END, 6) AS blended FROM sc JOIN u USING (doc_id) JOIN v USING (doc_id)""")
def _(spark, d):
    s = scored(spark, d)
    keep = s.groupBy(X.title_key(F.col("text")).alias("_k")).agg(F.min("doc_id").alias("doc_id"))
    up, down = F.col("n_chars") % 7, F.col("doc_id") % 5
    return s.join(keep, "doc_id", "left_semi").select("doc_id", rnd(X.vote_blend(F.col("sentiment"), up, down)).alias("blended"))


@query("news_sentiment", "A27 J15", f"""WITH {SCORE_SQL}, act AS (SELECT * FROM (VALUES ('AAA', 'tion'), ('BBB', 'ment'), ('ZZZ', 'eau')) x(ticker, word)),
l AS (SELECT unnest(tickers) AS ticker, doc_id, sentiment FROM sc UNION SELECT a.ticker, doc_id, sentiment FROM sc, act a WHERE contains(lower(text), a.word)), f AS (SELECT * FROM l)
SELECT '*' AS ticker, round(greatest(-1, least(1, avg(sentiment))), 6) AS score, count(*) AS volume, count(*) FILTER (WHERE sentiment > 0.05) AS bullish, count(*) FILTER (WHERE sentiment < -0.05) AS bearish FROM sc
UNION ALL SELECT ticker, round(greatest(-1, least(1, avg(sentiment))), 6), count(*), count(*) FILTER (WHERE sentiment > 0.05), count(*) FILTER (WHERE sentiment < -0.05) FROM f GROUP BY ticker""")
def _(spark, d):
    s = scored(spark, d)
    # the active names are a short fixed list: their text match is a projection, not a join
    active = {"AAA": "tion", "BBB": "ment", "ZZZ": "eau"}
    named = F.array_compact(F.array(*[F.when(F.contains(X.lowered(F.col("text")), F.lit(w)), t) for t, w in active.items()]))
    h = s.select(F.col("doc_id").alias("seq"), "sentiment", F.array_union("tickers", named).alias("tickers"))
    g, t = M.news_sentiment(h)
    both = g.select(F.lit("*").alias("ticker"), "score", "volume", "bullish", "bearish").unionByName(t)
    return both.withColumn("score", rnd("score"))


@query("sentiment_features", "F03", f"""WITH {SCORE_SQL} SELECT doc_id, round((n_chars % 101) / 100.0, 6)::DOUBLE AS index_norm, CASE WHEN n_chars % 101 < 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS extreme_fear, CASE WHEN n_chars % 101 > 75 THEN 1.0 ELSE 0.0 END::DOUBLE AS extreme_greed, round(sentiment, 6) AS news_score,
  round(least(len(tickers) / 50.0, 1.0), 6)::DOUBLE AS news_volume, round(CASE WHEN doc_id % 2 = 0 THEN uncertainty ELSE sentiment END, 6) AS ticker_score, round(abs(CASE WHEN doc_id % 2 = 0 THEN uncertainty ELSE sentiment END), 6) AS ticker_magnitude FROM sc""")
def _(spark, d):
    s = scored(spark, d)
    f = X.sentiment_features(F.col("n_chars") % 101, F.col("sentiment"), F.size("tickers"), F.when(F.col("doc_id") % 2 == 0, F.col("uncertainty")))
    return s.select("doc_id", *[rnd(c).alias(k) for k, c in f.items()])


TITLE_SQL = "trim(string_split(text, chr(10))[1])"


@query("first_headlines", "A27", f"SELECT doc_id AS seq, {TITLE_SQL} AS title FROM documents ORDER BY doc_id LIMIT 5")
def _(spark, d):
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.trim(F.split("text", "\n")[0]).alias("title"))
    return M.first_headlines(titles, 5)


@query("ticker_mentions", "J15", f"""WITH {SCORE_SQL}, sym AS (SELECT DISTINCT upper(substring(n_name, 1, 3)) AS ticker FROM nation UNION SELECT DISTINCT upper(substring(c_mktsegment, 1, 3)) FROM customer)
SELECT ticker, count(*) AS headlines, round(avg(sentiment), 6) AS sentiment, min(doc_id) AS first_doc FROM sc JOIN sym ON contains(lower({TITLE_SQL}), lower(ticker)) GROUP BY ticker""")
def _(spark, d):
    symbols = table(spark, d, "nation").select(F.upper(F.substring("n_name", 1, 3)).alias("ticker")).union(table(spark, d, "customer").select(F.upper(F.substring("c_mktsegment", 1, 3)))).distinct()
    titles = scored(spark, d).select("doc_id", "sentiment", F.trim(F.split("text", "\n")[0]).alias("title"))
    found = J.contains_join(titles, symbols, "title", "ticker")
    return found.groupBy("ticker").agg(F.count(F.lit(1)).alias("headlines"), rnd(F.avg("sentiment")).alias("sentiment"), F.min("doc_id").alias("first_doc"))
