"""Quality rules as a bitmask ledger: each rule is evaluated once, policies and ablations read bits.

`ledger` adds to every document the measurements and one long, `failed`, with bit i set where rule i fails.
A policy is a named, versioned set of rules; applying it is one AND, and its ablation (what each rule alone
rejects) is one aggregation over masks. A null or empty text has no words: all measurements are zero and only the
rule on few words fails. A rule with nothing to measure passes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import SPACES, let, word_array

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: The ledger's bits, in order: a rule fails where its condition holds. New rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
DEFAULT = Policy("default", 1, tuple(n for n, _ in RULES))


def _covered(pairs: Column) -> Column:
    """Words covered by repeated windows, from (window hash, position) pairs in order of both."""

    def positions(p: Column) -> Column:
        n = F.size(p)
        same = lambda i, j: F.get(p, i)["h"] == F.get(p, j)["h"]
        hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.array_sort(F.transform(hits, lambda i: F.get(p, i)["i"]))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n"))
    return let(pairs, lambda p: F.aggregate(let(p, positions), start, step, lambda a: a["n"]))


def repeated_words(words: Column) -> Column:
    """Words inside any 8-word window that occurs twice or more. Windows are told apart by 64-bit hashes."""
    count = lambda h: F.size(h)

    def widen(h: Column, by: int) -> Column:
        return let(h, lambda x: F.zip_with(F.slice(x, 1, F.greatest(count(x) - by, F.lit(0))), F.slice(x, by + 1, F.greatest(count(x) - by, F.lit(0))), lambda a, b: F.xxhash64(a, b)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = widen(widen(widen(hashes, 1), 2), 4)
    pairs = lambda g: F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_covered(pairs(g)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, some))


def ledger(docs: DataFrame, text: str = "text", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Every row of docs with `doc` (the whole row), the measurements and `failed`; no shuffle, one pass over the text."""
    body = F.coalesce(F.col(f"doc.{text}"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    lines = F.filter(F.split(body, "\n", -1), lambda s: s.rlike(r"[^ \t-\r]"))
    measured = rows.select(
        "doc",
        F.length(F.regexp_replace(body, SPACES + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda s: F.struct(F.size(s).cast("long").alias("n"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("dup"))).alias("_lines"),
        let(word_array(body), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat"))).alias("_words"),
    )
    named = measured.select("doc", F.col("_words.n").alias("n_words"), "word_chars", "n_symbols", F.col("_lines.dup").alias("n_dup_lines"), F.col("_words.repeat").alias("n_repeat_words"), F.col("_lines.n").alias("n_lines"))
    bits = [F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, condition) in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return named.withColumn("failed", failed)


def fails(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(docs: DataFrame, policy: Policy = DEFAULT, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only."""
    return ledger(docs, text).filter(~fails(policy)).select("doc.*")


def ablation(marks: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Per rule of the policy: rows it fails, and rows that only it rejects (they would stay without it)."""
    inside = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    masks = marks.groupBy(inside.alias("m")).agg(F.count("*").alias("n"))
    names = [n for n, _ in RULES]
    table = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules])
    rows = masks.select("m", "n", F.explode(table).alias("r"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return rows.groupBy(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule")).agg(
        count(F.col("m").bitwiseAND(F.col("r.bit")) != 0).alias("failing"), count(F.col("m") == F.col("r.bit")).alias("failing_alone")
    )
