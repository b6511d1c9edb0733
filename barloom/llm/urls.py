"""URL verdicts: written rules first, then logistic regression on hashed character n-grams of host and path.

Rules name a host and a path: a rule fits that host and its subdomains where the path begins with the rule's; the longest
fitting rule decides. All other URLs get the model's verdict. The model is fitted to a small labelled table of URLs (a parameter,
at most TRAIN_ROWS rows); features are counted n-grams of sizes NGRAMS, told apart by part, with digits alike.

A null URL, or one without `://`, has an empty host and path, fits no rule, and is allowed: there is nothing to judge.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.words import let

NGRAMS = (3, 4, 5)
FEATURES = 1 << 14
TRAIN_ROWS = 10_000
#: Fixed rules of the contract: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words of hosts that labelled URLs are made of, by rule below.
BAD = ("casino", "casino-win", "free-bets", "bets", "betting", "poker", "jackpot", "slots", "cheap-pills", "pills", "viagra", "pharma-deal", "payday-loans", "xxx", "adult-cams", "porn", "warez", "crack-keygen", "lottery-win", "replica-watches")
GOOD = ("news", "library", "school", "museum", "docs", "research", "garden", "weather", "recipes", "history", "thereon", "townhall", "ingenting", "stonehouse", "theother", "ration", "nation", "blehand", "anthology", "watering")
FRONT, TOP = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org")
PATHS = ("/en/1234", "/fr/5678.html", "/de/42/", "/es/906")


def labelled(spark: SparkSession) -> DataFrame:
    """(url, label): each word under every front, with tops and paths in turn."""
    rows = [(f"http://{f}{w}.{TOP[(i + j) % 3]}{PATHS[(i + j) % 4]}", y) for y, words in ((1.0, BAD), (0.0, GOOD)) for i, w in enumerate(words) for j, f in enumerate(FRONT)]
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in rows])).alias("r")).select("r.*")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def _parts(pages: DataFrame, url: str) -> DataFrame:
    """Rows as `doc` with host and path."""
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("doc"), F.col(url).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    return rows.withColumns({"host": host, "path": path})


def _grams(part: Column, name: str) -> Column:
    """The n-grams of a part: its characters are split once, and each n-gram is a slice of them."""
    marked = F.concat(F.lit("^"), F.translate(part, "0123456789", "0000000000"), F.lit("$"))

    def each(c: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(c) - (n - 1), F.lit(1)))
        return F.when(F.size(c) >= n, F.transform(starts, lambda i: F.concat(F.lit(f"{name}:"), F.array_join(F.slice(c, i, n), "")))).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(marked, "", -1), lambda x: x != ""), lambda c: F.concat(*[each(c, n) for n in NGRAMS]))


def _with_grams(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))


def fit(table: DataFrame, url: str = "url", label: str = "label") -> PipelineModel:
    """The model of a small labelled table (1 is block)."""
    if table.limit(TRAIN_ROWS + 1).count() > TRAIN_ROWS:
        raise ValueError(f"more than {TRAIN_ROWS} labelled URLs")
    rows = _with_grams(_parts(table, url)).select("_grams", F.col(f"doc.{label}").cast("double").alias("_label")).coalesce(1)
    stages = [HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES), LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_y", regParam=0.01, maxIter=100)]
    return Pipeline(stages=stages).fit(rows)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host and path in one string, and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    pick = lambda of: F.coalesce(*[F.when(fits(h, p), F.lit(of(v, h, p))) for v, h, p in ordered], F.lit(None).cast("string"))
    return pick(lambda v, h, p: h + p), pick(lambda v, h, p: v)


def judge(pages: DataFrame, model: PipelineModel, url: str = "url", rules=RULES, threshold: float = 0.7) -> DataFrame:
    """Every row as `doc`, with host, path, rule, verdict and the model's probability of block."""
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = model.transform(_with_grams(_parts(pages, url)))
    p = vector_to_array("_p")[1]
    return scored.select("doc", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when((F.col("host") != "") & (p >= threshold), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), p.alias("p_block"))


def keep_allowed(pages: DataFrame, model: PipelineModel, url: str = "url") -> DataFrame:
    """The pages that are allowed, with their own columns."""
    return judge(pages, model, url).filter("verdict = 'allow'").select("doc.*")
