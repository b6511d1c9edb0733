"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, hmm_lm, language, licenses, mixing, negatives, periodic, quality_model, rules, secrets, simhash, tokens, urls
from barloom.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT r, i, list_slice(w, i, i + 7) AS g FROM w, unnest(range(1, len(w) - 6)) AS t(i) WHERE len(w) >= 8),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM d, unnest(string_split(text, chr(10))) AS t(l) WHERE regexp_matches(l, '[^ \t-\r]') GROUP BY r),
m AS (SELECT d.doc_id, len(w.w) AS n_words, length(regexp_replace(text, '[ \t-\r]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) | (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
  | (CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END) | (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
  | (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words) THEN 16 ELSE 0 END) AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed FROM b"""


@query("op7_quality_rules", RULES_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    marks = rules.ledger(table(spark, sf, "documents"))
    return marks.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rules.fails(rules.BASE).alias("base_failed"), (~rules.fails(rules.DEFAULT)).alias("kept"), "failed",
    )


@query("op1_mixing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixing.sized(table(spark, sf, "documents"), "text", "source", "doc_id")
    sizes = written(rows.select(F.col("doc.doc_id").alias("doc_id"), "size", "_s", "_null", "u"))
    out = mixing.with_copies(sizes, mixing.plan(sizes))
    return out.select(
        "doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        F.when(F.col("_null"), None).otherwise(F.col("_s")).alias("source"), "rate",
    )


@query("op2_simhash")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    rows = simhash.fingerprints(table(spark, sf, "documents").select("doc_id", "text"), "text")
    out = simhash.with_component(rows, "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_decontamination")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    marks = decontaminate.mark(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    ends = F.filter("spans", lambda x, i: i % 2 == 1)
    starts = F.filter("spans", lambda x, i: i % 2 == 0)
    n_hit = F.aggregate(F.zip_with(ends, starts, lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return marks.select(
        "doc.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query("op10_token_ids")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    folder = tokens.encode(table(spark, sf, "documents").select("doc_id", "text"), vocabulary())
    return tokens.digests(spark, folder)


def remainder(modulus: int):
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


@query("op4_quality_model")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    machine = quality_model.fit(*quality_model.sample(docs, table(spark, sf, "labels"), remainder(5) != 0))
    out = quality_model.score(docs.withColumn("held_out", remainder(5) == 0), machine)
    return out.select("doc.doc_id", "doc.held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op3_hmm_lm")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn("held_out", remainder(10) == 0)
    out, model = hmm_lm.score_all(docs, ~F.col("held_out"))
    return out.select("doc.doc_id", "doc.held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op5_secret_scan")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    out = secrets.scan(table(spark, sf, "documents").select("doc_id", "text", "source"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    return out.select(
        "doc.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.listing(base), 256).alias("base_sha256"),
        secrets.listing(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


@query("op6_language_id")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, remainder(4) != 2)
    out = language.predict(docs.select("doc_id", "text").withColumn("held_out", remainder(4) == 2), model)
    return out.select("doc.doc_id", "doc.held_out", "lang_pred", "score")


@query("op8_url_filter")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    model = urls.fit(urls.labelled(spark))
    return urls.judge(table(spark, sf, "pages").select("page_id", "url"), model).select("doc.page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))


def _licenses_sql() -> str:
    """The same votes in SQL, pairs compared as words."""
    rows = ", ".join(f"({i}, '{label}', '{text}', {i < len(licenses.BASE)})" for i, (label, text) in enumerate((*licenses.BASE, *licenses.TEMPLATES)))
    share = lambda c: f"bit_count({c} | ({c} << 1))::DOUBLE / size"
    near = f"OVER (PARTITION BY r, tid ORDER BY d RANGE BETWEEN {licenses.SLACK} PRECEDING AND {licenses.SLACK} FOLLOWING)"
    return rf"""
WITH tpl AS (SELECT * FROM (VALUES {rows}) AS v(tid, label, txt, is_base)),
tw AS (SELECT tid, label, is_base, string_split(txt, ' ') AS w FROM tpl),
tg AS (SELECT tid, label, is_base, len(w) AS size, t, w[t + 1] AS a, w[t + 2] AS b FROM tw, unnest(range(0, len(w) - 1)) AS u(t)),
docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT r, i, w[i + 1] AS a, w[i + 2] AS b FROM docs, unnest(range(0, len(w) - 1)) AS u(i)),
votes AS (SELECT r, tid, label, is_base, size, i - t AS d, bit_or(1::BIGINT << t) AS m FROM dg JOIN tg USING (a, b) GROUP BY ALL),
around AS (SELECT *, {share("m")} AS straight, bit_or(m) {near} AS mm FROM votes),
full_ AS (SELECT *, CASE WHEN size >= {licenses.NOTICE} THEN {share("mm")} ELSE straight END AS merged FROM around),
peaks AS (SELECT *, max((merged, straight, -d)) {near} = (merged, straight, -d) AS peak FROM full_),
held AS (SELECT *, bit_count(m) = size - 1 OR (size >= {licenses.NOTICE} AND merged >= {licenses.NEARLY} AND peak) AS held FROM peaks),
agg AS (SELECT r, count(*) FILTER (held AND is_base) AS n, min(d) FILTER (held AND is_base) AS lo, max(d) FILTER (held AND is_base) AS hi,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (held AND is_base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (held) AS al, max(merged) AS score FROM held GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN agg USING (r)"""


@query("op11_license_scan", _licenses_sql())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    out = licenses.scan(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


NEGATIVES_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.nth ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf, "embeddings"), F.col("id") % 50 == 0, label)


#: crc32 of the decimal id, byte by byte and bit by bit; agreement of words at distance p; stretches of it by gaps.
PERIODIC_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
  xor(list_reduce(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT), lambda h, c: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(h, c)), 4294967295::BIGINT), 4294967295) AS h FROM documents),
a AS (SELECT *, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
b AS (SELECT *, 1 + (len(w) - a) // (3 + g % 8) AS p FROM a),
x AS (SELECT r, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN w[1:a] || list_transform(range(0, len(w) - a), lambda i: w[a + i % p + 1]) ELSE w END AS w FROM b),
word AS (SELECT r, i, w[i + 1] AS v, len(w) AS n FROM x, unnest(range(0, len(w))) AS u(i)),
pair AS (SELECT a.r, b.i - a.i AS p, a.i FROM word a JOIN word b ON a.r = b.r AND a.v = b.v AND a.i < b.i AND 3 * (b.i - a.i) <= a.n),
isle AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM pair),
run AS (SELECT r, min(i) AS s, count(*) + p AS l, p FROM isle GROUP BY r, p, k HAVING count(*) + p >= greatest(24, 3 * p)),
least_ AS (SELECT r, s, l, min(p) AS p FROM run GROUP BY r, s, l),
listed AS (SELECT r, count(*) AS n, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS t FROM least_ GROUP BY r),
top AS (SELECT r, s, l, p FROM least_ QUALIFY row_number() OVER (PARTITION BY r ORDER BY l::DOUBLE / p DESC, s, p) = 1),
gone AS (SELECT DISTINCT r, unnest(range(s + p, s + l)) AS i FROM least_),
kept AS (SELECT r, string_agg(v, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, top.p::BIGINT AS period, (1000 * l // top.p)::BIGINT AS exponent_milli,
  sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM x LEFT JOIN listed USING (r) LEFT JOIN top USING (r) LEFT JOIN kept USING (r)"""


@query("op13_periodic_runs", PERIODIC_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    seed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    marks = periodic.mark(table(spark, sf, "documents").select("doc_id", periodic.with_period(F.col("text"), seed).alias("text")))
    line = lambda x: F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")])
    rows = marks.select("doc.doc_id", F.size("runs").cast("bigint").alias("n_runs"), periodic.most_repeated(F.col("runs")).alias("top"), F.array_join(F.transform("runs", lambda x: F.concat(line(x), F.lit("\n"))), "").alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
