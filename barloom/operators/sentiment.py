"""Text sentiment: a trained classifier at scale, bipolar scores, aggregation and temporal features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.columns import as_col, equi, ratio
from barloom.operators.features import frame
from barloom.plans.panel import KEYS, running, windowed
from barloom.plans.quantiles import exact_quantiles

# Class order and the neutral answer of the reference contract.
CLASSES = ("positive", "negative", "neutral")
EMPTY_TEXT = "No content"
NEUTRAL = {"sentiment_score": 0.0, "positive": 0.33, "negative": 0.33, "neutral": 0.34}


def _text(df: DataFrame, text: str) -> DataFrame:
    filled = F.when(F.coalesce(F.col(text), F.lit("")) == "", EMPTY_TEXT).otherwise(F.col(text))
    return df.withColumn("_text", filled)


def _label() -> Column:
    index = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("label")) - 1
    return index.cast("double")


def train_sentiment(labelled: DataFrame, text: str = "text", features: int = 1 << 14, reg: float = 0.01, max_iter: int = 20):
    """Hashed term counts into a multinomial logistic regression; `label` holds the class names."""
    rows = _text(labelled, text).withColumn("_label", _label())
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern="\\W+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        LogisticRegression(featuresCol="_tf", labelCol="_label", probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred",
                           regParam=reg, maxIter=max_iter, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(rows)


def score_sentiment(model, df: DataFrame, text: str = "text") -> DataFrame:
    """Adds positive, negative and neutral probabilities and the bipolar score; whole texts, no cut."""
    scored = model.transform(_text(df, text)).withColumn("_p", vector_to_array("_prob"))
    out = scored.select(*df.columns, *[F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)).alias(c) for i, c in enumerate(CLASSES)])
    return out.withColumn("sentiment_score", bipolar_score())


def bipolar_score(positive: Column | str = "positive", negative: Column | str = "negative") -> Column:
    return as_col(positive) - as_col(negative)


def aggregate_sentiment(df: DataFrame, by: Sequence[str], score: str = "sentiment_score") -> DataFrame:
    """Mean, exact median and confidence-weighted mean (0 when all weights are 0) per key."""
    by, s = list(by), F.col(score)
    sums = df.groupBy(*by).agg(
        F.count(score).alias("n"),
        F.avg(score).alias("mean_score"),
        F.coalesce(ratio(F.sum(s * F.abs(s)), F.sum(F.abs(s))), F.lit(0.0)).alias("weighted_score"),
    )
    median = exact_quantiles(df, by, score, [0.5], "_q").select(*by, F.col("_q")[0].alias("median_score"))
    return equi(sums, median, by)


def dominant_label(cols: Sequence[str] = CLASSES) -> tuple[Column, Column]:
    """(label, confidence); the first class wins a tie."""
    best = F.greatest(*cols)
    label = F.lit(None).cast("string")
    for c in reversed(cols):
        label = F.when(F.col(c) == best, c).otherwise(label)
    return label, best


def neutral_default(df: DataFrame, text: str = "text") -> DataFrame:
    """Neutral constants when there is no text column at all."""
    return df if text in df.columns else df.withColumns({c: F.lit(v) for c, v in NEUTRAL.items()})


def sentiment_regime(score: Column | str) -> Column:
    s = as_col(score)
    # fixed values: the regime names and their bounds
    return (
        F.when(s < -0.5, "strongly_bearish")
        .when(s < -0.2, "bearish")
        .when(s > 0.5, "strongly_bullish")
        .when(s > 0.2, "bullish")
        .when(s.isNotNull(), "neutral")
    )


def temporal_features(df: DataFrame, score: str = "sentiment_score", keys: Sequence[str] = KEYS, fill: bool = True) -> DataFrame:
    """Moving averages, momentum, volatility and divergence of a daily score; leading gaps filled backward."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns(
            {
                "sentiment_ma7": F.avg(score).over(frame(w, 7)),
                "sentiment_ma21": F.avg(score).over(frame(w, 21)),
                "sentiment_momentum": F.col(score) - F.lag(score, 5).over(w),
                "sentiment_volatility": F.stddev_samp(score).over(frame(w, 14)),
            }
        )
        return d.withColumn("sentiment_divergence", F.col(score) - F.col("sentiment_ma21"))

    out = windowed(df, build, back=20, keys=keys)
    cols = ("sentiment_momentum", "sentiment_volatility")
    return running(out, {c: ("next", F.col(c)) for c in cols}, keys) if fill else out
