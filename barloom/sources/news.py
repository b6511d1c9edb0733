"""News articles: JSON parsing and the daily digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.schemas import ARTICLE

HEADLINES_PER_DAY = 10


def parse_news_articles(raw: DataFrame, article: str = "article") -> DataFrame:
    """date, title, description, source, url from article JSON; missing text becomes ""."""
    a = raw.withColumn("_a", F.from_json(article, ARTICLE))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return a.select(
        F.try_to_timestamp(F.col("_a.publishedAt")).alias("date"),
        text("_a.title").alias("title"),
        text("_a.description").alias("description"),
        text("_a.source.name").alias("source"),
        text("_a.url").alias("url"),
    ).orderBy("date")


def news_daily_digest(news: DataFrame, k: int = HEADLINES_PER_DAY, tie: str = "url") -> DataFrame:
    """date, headlines: the first k titles of each day joined by " | ".

    The rank limit is planned before the shuffle, so a crowded day sends at most k rows per task.
    """
    day = F.to_date("date")
    w = Window.partitionBy("day").orderBy("date", tie)
    top = news.select(day.alias("day"), "date", tie, "title").withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "title"))), lambda s: s["title"]), " | ")
    return top.groupBy(F.col("day").alias("date")).agg(joined.alias("headlines"))
