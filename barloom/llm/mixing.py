"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and `most` copies. Among all rates that meet each source's word target, those
nearest to one copy (in relative entropy) are exponential tilts of the size, min(most, exp(lambda * size / scale)),
with one multiplier a source. Newton steps on the convex dual find the multipliers over a table of (source, size,
documents); a bracket guards each step. Rates become whole copies: the whole part is taken, the rest is drawn by
hashed priority (hash / fraction) up to a cut per source that meets what is missing, so a source ends within one
document of its target wherever its documents can. Everything is a function of the rows: reruns agree.

Null sources are a source of their own, last in order. Null or empty texts have size 0, one copy, no words. Rows equal
in id and text are drawn alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.words import n_words
from barloom.session import discard, written

SHIFT = 4.0  # longest Newton step, in logarithms of a rate at the scale of its source
BINS = 4096
BROADCAST_BYTES = 8 << 20
ROW_BYTES = 200


def _sources_of(per_source: DataFrame) -> DataFrame:
    """Broadcast a table of one row a source where its size allows; else it is joined by shuffle."""
    fits = per_source.count() * ROW_BYTES <= BROADCAST_BYTES
    return F.broadcast(per_source) if fits else per_source


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(_s, _null, total) with `target`: shares by weight of share * all words, each at most `most` times its source.

    Weights repeat along the sources in order. The water level is closed form: with sources ordered by
    cap / weight, the first k are full where the level of the rest lies between the ratios k and k + 1.
    """
    order = Window.orderBy("_null", "_s")
    rows = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    rows = rows.withColumns({"_cap": F.col("total") * most, "_ratio": F.col("total") * most / F.col("_w")})
    by = Window.orderBy("_ratio", "_null", "_s")
    upto, all_ = by.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    rows = rows.withColumns({
        "_level": (F.sum("total").over(all_) * F.lit(share) - F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        / (F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))),
    })
    # the level after the full sources is the first one below the next ratio
    open_ = F.min(F.when(F.col("_level") < F.col("_ratio"), F.struct("_ratio", "_null", "_s", "_level"))).over(all_)
    rows = rows.withColumn("_at", open_["_level"])
    return rows.select("_s", "_null", "total", F.when(F.col("_at").isNull() | (F.col("_w") * F.col("_at") >= F.col("_cap")), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_at")).alias("target"))


def _rate(lam: Column, size: Column, scale: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(700.0), lam * size / scale)))


def multipliers(cells: DataFrame, goals: DataFrame, most: int, tolerance: float = 1e-10, rounds: int = 60) -> DataFrame:
    """(_s, _null, total, target, scale, lam): the dual solution of every source."""
    scales = cells.groupBy("_s", "_null").agg(F.coalesce(F.try_divide(F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")), F.sum(F.col("size") * F.col("n"))), F.lit(1.0)).alias("scale"))
    solved = (F.col("total") == 0) | (F.col("target") >= F.col("total") * most)
    state = written(
        goals.join(scales, ["_s", "_null"]).select(
            "_s", "_null", "total", "target", F.greatest("scale", F.lit(1e-9)).alias("scale"), F.lit(0.0).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), solved.alias("done"),
        )
    )
    for _ in range(rounds):
        if state.filter("NOT done").isEmpty():
            break
        z = F.col("size").cast("double")
        near = cells.join(_sources_of(state.filter("NOT done").select("_s", "_null", "lam", "scale")), ["_s", "_null"])
        r = _rate(F.col("lam"), z, F.col("scale"), most)
        sums = near.groupBy("_s", "_null").agg(
            F.sum(F.col("n") * z * r).alias("g"), F.sum(F.when(r < most, F.col("n") * z * z / F.col("scale") * r).otherwise(0.0)).alias("h")
        )
        both = state.join(sums, ["_s", "_null"], "left")
        gap = F.col("g") - F.col("target")
        done = F.col("done") | (F.abs(gap) <= tolerance * F.col("target"))
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.when(F.col("h") > 0, F.greatest(F.lit(-SHIFT), F.least(F.lit(SHIFT), F.try_divide(-gap, F.col("h"))))).otherwise(-F.signum(gap) * SHIFT)
        both = both.select("_s", "_null", "total", "target", "scale", "lam", lo.alias("lo"), hi.alias("hi"), done.alias("done"), (F.col("lam") + step).alias("to"))
        inside = (F.col("to") > F.col("lo")) & (F.col("to") < F.col("hi"))
        new = F.when(F.col("done"), F.col("lam")).when(inside, F.col("to")).otherwise((F.col("lo") + F.col("hi")) / 2)
        old, state = state, written(both.select("_s", "_null", "total", "target", "scale", new.alias("lam"), "lo", "hi", "done"))
        discard(old)
    full = (F.col("target") >= F.col("total") * most) & (F.col("total") > 0)
    return state.select("_s", "_null", "total", "target", "scale", F.when(full, F.lit(float("inf"))).otherwise(F.col("lam")).alias("lam"))


def _parts(most: int) -> tuple[Column, Column, Column]:
    """Rate, its whole part, and the hashed priority of its fraction in [0, 1) (null without one)."""
    z = F.col("size").cast("double")
    r = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam") == float("inf"), F.lit(float(most))).otherwise(_rate(F.col("lam"), z, F.col("scale"), most))
    whole = F.floor(r)
    rest = r - whole
    u = F.try_divide(F.col("u"), rest)
    return r, whole, F.when((rest > 0) & (F.col("size") > 0), u / (1 + u))


def _cuts(sized: DataFrame, per_source: DataFrame, most: int, rounds: int = 4) -> DataFrame:
    """The priority up to which each source takes one more copy, found by narrowing histograms of words."""
    _, whole, key = _parts(most)
    rows = sized.join(_sources_of(per_source), ["_s", "_null"]).select("_s", "_null", "size", whole.alias("_whole"), key.alias("_key"))
    left = rows.groupBy("_s", "_null").agg(F.sum(F.col("size") * F.col("_whole")).alias("_taken"))
    state = written(per_source.join(left, ["_s", "_null"]).select("_s", "_null", (F.col("target") - F.col("_taken")).alias("need"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(0).alias("n")))
    keyed = rows.filter("_key IS NOT NULL").select("_s", "_null", "size", "_key")
    for i in range(rounds):
        inside = keyed.join(_sources_of(state.filter("n <> 1") if i else state), ["_s", "_null"]).filter("_key >= lo AND _key < hi")
        bins = inside.groupBy("_s", "_null", F.least(F.lit(BINS - 1), F.floor((F.col("_key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).alias("bin")).agg(
            F.sum("size").alias("w"), F.count("*").alias("m"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("need").alias("need")
        )
        # one row a source and bin: at most BINS rows a source
        upto = F.sum("w").over(Window.partitionBy("_s", "_null").orderBy("bin"))
        at = bins.withColumn("_upto", upto).filter("_upto >= need").groupBy("_s", "_null").agg(F.min(F.struct("bin", "w", "m", "_upto", "lo", "hi", "need")).alias("b"))
        width = (F.col("b.hi") - F.col("b.lo")) / BINS
        found = at.select(
            "_s", "_null", (F.col("b.need") - (F.col("b._upto") - F.col("b.w"))).alias("_need"), (F.col("b.lo") + width * F.col("b.bin")).alias("_lo"),
            (F.col("b.lo") + width * (F.col("b.bin") + 1)).alias("_hi"), F.col("b.m").cast("int").alias("_n"), F.col("b.w").alias("_w"),
        )
        joined = state.join(found, ["_s", "_null"], "left")
        pick = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
        old, state = state, written(joined.select("_s", "_null", pick("need"), pick("lo"), pick("hi"), pick("n"), *([F.col("_w").alias("w")] if not i else [F.coalesce("_w", "w").alias("w")])))
        discard(old)
        if state.filter("n > 1").isEmpty():
            break
    # the last bin goes to the side that ends nearer to the target; w is null where all of a source is needed
    cut = F.when(F.col("w").isNull(), F.when(F.col("need") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).when(2 * F.col("need") >= F.col("w"), F.col("hi")).otherwise(F.col("lo"))
    return state.select("_s", "_null", cut.alias("cut"))


def sized(docs: DataFrame, text: str, source: str, doc_id: str) -> DataFrame:
    """Each row as `doc`, with its size, its source as two non-null columns, and a hash in (0, 1)."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    s = F.col(f"doc.{source}")
    h = F.xxhash64(F.col(f"doc.{doc_id}"), F.col(f"doc.{text}"))
    return rows.select(
        "doc", n_words(F.col(f"doc.{text}")).cast("long").alias("size"), F.coalesce(s.cast("string"), F.lit("")).alias("_s"),
        s.isNull().alias("_null"), ((F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(float(1 << 53))).alias("u"),
    )


def plan(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(_s, _null, total, target, scale, lam, cut) per source, from a written table of (size, _s, _null, u)."""
    cells = written(sizes.groupBy("_s", "_null", "size").agg(F.count("*").alias("n")))
    per_source = cells.groupBy("_s", "_null").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    per_source = written(multipliers(cells, targets(per_source, weights, share, most), most))
    return written(per_source.join(_cuts(sizes, per_source, most), ["_s", "_null"]))


def with_copies(rows: DataFrame, plan: DataFrame, most: int = 2) -> DataFrame:
    """Add `rate` and `copies` (and the plan's columns) to rows made by `sized`."""
    r, whole, key = _parts(most)
    out = rows.join(_sources_of(plan), ["_s", "_null"]).withColumns({"rate": r, "_whole": whole, "_key": key})
    return out.withColumn("copies", (F.col("_whole") + F.when(F.col("_key") < F.col("cut"), 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: documents with their own columns, repeated as often as they are taken."""
    rows = sized(docs, text, source, doc_id)
    sizes = written(rows.select("size", "_s", "_null", "u"))
    out = with_copies(rows, plan(sizes, weights, share, most), most)
    return out.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
