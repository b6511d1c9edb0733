"""Secret scans with corpus-wide ownership frequency.

Base candidates are regular-expression matches, leftmost and non-overlapping per kind: `assign` (a secret-like name, a
sign and a value), `access` (access-key ids) and `hex`. Further kinds are long tokens that mix letters and digits and
well-known credential prefixes. Each candidate's value is hashed; over the whole corpus the distinct owners and
repositories of every hash are counted, copies within a repository counting once. A value in at most `owners` owners and
`repositories` repositories looks live; one spread over more owners, or copied all over one owner's repositories, is a
widely copied example. Base candidates are all kept and labelled with their verdict; further ones stay only where they
look live and overlap no base candidate.

Positions count code points, ends are exclusive. Null and empty texts have no candidates; null owners and repositories
are values of their own; equal rows are separate rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.words import let
from barloom.session import written

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: (pattern, part that is the value, least characters of the value). Fixed values of the contract, in its order.
BASE = {"assign": (ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
#: Further kinds: published credential prefixes, and mixed tokens.
MORE = {
    "prefixed": (r"(?:gh[pousr]_|github_pat_|xox[abprs]-|sk_live_|rk_live_|glpat-|AIza|eyJ)[A-Za-z0-9_.-]{16,}", 0, 20),
    "mixed": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{24,}", 0, 24),
}
KINDS = [*BASE, *MORE]
OWNERS, REPOSITORIES = 2, 16
MATCHES = "array<struct<rank:int,nth:int,gap:bigint,size:bigint,n:int,hash:string>>"


def _matches(text: Column, kind: str) -> Column:
    """Matches of a kind in order, with the length of the text between each and the one before: a place is a running sum of
    these. Texts that lack the kind pay for one test."""
    pattern, part, _ = {**BASE, **MORE}[kind]
    # runs of a kind without parts can be asked for at their least length at once: a run is leftmost and maximal
    probe = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}.get(kind, pattern)
    found = F.struct(
        F.regexp_extract_all(text, F.lit(probe), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(probe), F.lit(part)).alias("value"),
        F.split(text, probe, -1).alias("gap"),
    )

    def listed(f: Column) -> Column:
        return F.transform(f["whole"], lambda w, i: F.struct(
            F.lit(KINDS.index(kind)).alias("rank"), i.alias("nth"), F.length(F.get(f["gap"], i)).cast("bigint").alias("gap"), F.length(w).cast("bigint").alias("size"),
            F.length(F.get(f["value"], i)).alias("n"), F.sha2(F.get(f["value"], i), 256).alias("hash"),
        ))

    return F.when(text.rlike(probe), let(found, listed)).otherwise(F.array().cast(MATCHES))


def candidates(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Two written tables: every row, `doc` without its text, by number; and the spans (row, owner, repository, start, rank,
    end, hash) of base kinds and of further ones that overlap none of these. Work and memory are linear in a text."""
    body = F.coalesce(F.col(text), F.lit(""))
    keep = F.struct(*[docs[c] for c in docs.columns if c != text]) if len(docs.columns) > 1 else F.struct(F.lit(0).alias("_"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), keep.alias("doc"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"),
        F.concat(*[_matches(body, k) for k in KINDS]).alias("found"),
    )
    table = written(rows)
    each = table.filter(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("m")).select("row", "owner", "repository", "m.*")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    least = F.get(F.array(*[F.lit({**BASE, **MORE}[k][2]) for k in KINDS]), F.col("rank"))
    placed = each.withColumn("end", upto).withColumn("start", F.col("end") - F.col("size")).filter(F.col("n") >= least)
    is_base = F.col("rank") < len(BASE)
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = placed.withColumn("_end", F.max(F.when(is_base, F.col("end"))).over(before)).withColumn("_next", F.min(F.when(is_base, F.col("start"))).over(after))
    free = (F.coalesce("_end", F.col("start")) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end"))
    return table, written(near.filter(is_base | free).select("row", "owner", "repository", "start", "rank", "end", "hash"))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, owners, repositories): each value's distinct owners and repositories over the corpus.

    Distinct (hash, owner, repository) first, then sums per owner, then per hash: a value in a third of all rows is
    reduced inside the tasks that read it and never meets in one.
    """
    once = spans.select("owner", "repository", "hash").distinct()
    return once.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, owners: int = OWNERS, text: str = "text", owner: str = "source", repository: str = "doc_id", repositories: int = REPOSITORIES) -> DataFrame:
    """Every row, `doc` without its text, with `spans`: array of (start, rank, end, hash, owners, repositories, live), in order."""
    table, placed = candidates(docs, text, owner, repository)
    known = placed.join(ownership(placed), "hash")
    live = (F.col("owners") <= owners) & (F.col("repositories") <= repositories)
    kept = known.filter(live | (F.col("rank") < len(BASE)))
    spans = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "hash", "owners", "repositories", live.alias("live")))).alias("spans"))
    return table.select("row", "doc").join(spans, "row", "left").select("doc", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
