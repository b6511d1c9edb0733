"""Sentiment queries over the documents and their labels, and over event-day scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import query, rounded, rsql
from barloom.operators import sentiment as sen
from barloom.plans.panel import row_index
from barloom.session import cut_lineage
from barloom.sources import fixtures as fx

# A fixed linear model over the words of the whole text, so that SQL can repeat the scores; labels add to it where
# a document has them.
UP = ("with", "for", "and", "mit", "und", "avec", "et", "con", "y")
DOWN = ("not", "no", "nicht", "pas", "ne", "idiot", "stupid", "moron", "trash", "loser", "clown", "scum", "pathetic", "worthless")
_SPLIT = "[ \\t\\n.,!?|]+"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_PROB = f"""w AS (SELECT doc_id, lang, source, regexp_split_to_array(lower(coalesce(text, '')), '{_SPLIT}') AS w FROM documents),
  c AS (SELECT doc_id, lang, source, len(list_filter(w, lambda x: x IN {_IN(UP)})) AS up, len(list_filter(w, lambda x: x IN {_IN(DOWN)})) AS down, len(w) AS n FROM w),
  pr AS (SELECT c.doc_id, lang, source, (1 + 4 * up + n * coalesce(l.quality, 0) * 0.25::DOUBLE) AS a, (1 + 40 * down + n * coalesce(l.toxic, 0) * 0.5::DOUBLE) AS b, 1 + n * 0.5::DOUBLE AS m
    FROM c LEFT JOIN labels l USING (doc_id)),
  ps AS (SELECT *, a / (a + b + m) AS positive, b / (a + b + m) AS negative, m / (a + b + m) AS neutral, a / (a + b + m) - b / (a + b + m) AS score FROM pr)"""


def probabilities(spark, sf):
    """Class probabilities of every document, from its whole text."""
    d = fx.table(spark, sf, "documents").select("doc_id", "lang", "source", F.split(F.lower(F.coalesce("text", F.lit(""))), "[ \\t\\n.,!?|]+", -1).alias("_w"))
    count = lambda words: F.size(F.filter("_w", lambda x: x.isin(*words)))
    d = d.select("doc_id", "lang", "source", count(UP).alias("_up"), count(DOWN).alias("_down"), F.size("_w").alias("_n")).join(fx.table(spark, sf, "labels"), "doc_id", "left")
    quality, toxic = F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))
    d = d.withColumns({"_a": 1 + 4 * F.col("_up") + F.col("_n") * quality * 0.25, "_b": 1 + 40 * F.col("_down") + F.col("_n") * toxic * 0.5, "_m": 1 + F.col("_n") * 0.5})
    total = F.col("_a") + F.col("_b") + F.col("_m")
    d = d.withColumns({"positive": F.col("_a") / total, "negative": F.col("_b") / total, "neutral": F.col("_m") / total})
    return d.withColumn("sentiment_score", sen.bipolar_score()).drop("_a", "_b", "_m", "_n", "_up", "_down")


@query("score_sentiment")
def _(spark, sf):
    """Trained on the labelled documents, applied to every document."""
    labelled = cut_lineage(fx.labelled_documents(spark, sf))
    model = sen.train_sentiment(labelled)
    return sen.score_sentiment(model, fx.table(spark, sf, "documents").select("doc_id", "lang", "text")).drop("text")


@query("score_sentiment_checks", "SELECT count(*) AS n, 0::BIGINT AS n_bad FROM documents")
def _(spark, sf):
    """Every document scored once: probabilities add up to one and the score is their difference."""
    labelled = cut_lineage(fx.labelled_documents(spark, sf))
    out = sen.score_sentiment(sen.train_sentiment(labelled), fx.table(spark, sf, "documents").select("doc_id", "text"))
    total = F.col("positive") + F.col("negative") + F.col("neutral")
    bad = (F.abs(total - 1) > 1e-9) | (F.abs(F.col("sentiment_score") - (F.col("positive") - F.col("negative"))) > 1e-12) | (F.least("positive", "negative", "neutral") < 0)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("n_bad"))


@query("bipolar_score", f"WITH {_PROB} SELECT doc_id, round(score, 8) AS score FROM ps")
def _(spark, sf):
    return rounded(probabilities(spark, sf).select("doc_id", F.col("sentiment_score").alias("score")), 8)


@query("aggregate_sentiment", f"""WITH {_PROB} SELECT lang, count(score) AS n, {rsql(6, mean_score='avg(score)', weighted_score='coalesce(sum(score * abs(score)) / nullif(sum(abs(score)), 0), 0)', median_score='quantile_cont(score, 0.5)')} FROM ps GROUP BY 1""")
def _(spark, sf):
    return rounded(sen.aggregate_sentiment(probabilities(spark, sf), ["lang"]), 6)


@query("dominant_label", f"""WITH {_PROB} SELECT doc_id, CASE WHEN positive = g THEN 'positive' WHEN negative = g THEN 'negative' ELSE 'neutral' END AS label, round(g, 8) AS confidence
  FROM (SELECT *, greatest(positive, negative, neutral) AS g FROM ps)""")
def _(spark, sf):
    label, conf = sen.dominant_label()
    return rounded(probabilities(spark, sf).select("doc_id", label.alias("label"), conf.alias("confidence")), 8)


@query("neutral_default", "SELECT doc_id, 0::DOUBLE AS sentiment_score, 0.33::DOUBLE AS positive, 0.33::DOUBLE AS negative, 0.34::DOUBLE AS neutral FROM documents")
def _(spark, sf):
    return sen.neutral_default(fx.table(spark, sf, "documents").select("doc_id"))


@query("sentiment_regime", f"""WITH {_PROB} SELECT CASE WHEN score < -0.5 THEN 'strongly_bearish' WHEN score < -0.2 THEN 'bearish' WHEN score > 0.5 THEN 'strongly_bullish' WHEN score > 0.2 THEN 'bullish' ELSE 'neutral' END AS regime,
  count(*) AS n FROM ps GROUP BY 1""")
def _(spark, sf):
    return probabilities(spark, sf).groupBy(sen.sentiment_regime("sentiment_score").alias("regime")).agg(F.count(F.lit(1)).alias("n"))


_W = "PARTITION BY series_id ORDER BY day"


def _o(e, n):
    return f"{e} OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_BF = lambda c: f"first_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("sentiment_temporal_features", f"""WITH dy AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS day, avg(value) / 100 - 0.5::DOUBLE AS s FROM events GROUP BY 1, 2),
  t AS (SELECT series_id, day, s, {_o('avg(s)', 7)} AS ma7, {_o('avg(s)', 21)} AS ma21, s - lag(s, 5) OVER ({_W}) AS mom, {_o('stddev_samp(s)', 14)} AS vol FROM dy)
  SELECT series_id, day, {rsql(8, sentiment_ma7='ma7', sentiment_ma21='ma21', sentiment_momentum=_BF('mom'), sentiment_volatility=_BF('vol'), sentiment_divergence='s - ma21')} FROM t""")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    daily = e.groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("day")).agg((F.avg("value") / 100 - 0.5).alias("sentiment_score"))
    out = sen.temporal_features(row_index(daily, order="day"))
    return rounded(out.drop("row_idx", "sentiment_score"), 8)
