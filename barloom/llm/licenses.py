"""License scans by diagonal voting over word pairs, in DataFrame functions only.

Templates are phrases, statements and notices of 2 to 63 words. The hash of every pair of neighbouring words of every
text is joined to the template positions that begin with such a pair. A hit of position t at word w votes for the
diagonal w - t, the word where the template would begin. Votes of a diagonal are the bits of one number; those of the
diagonals within SLACK of it are merged in, so that a notice with words put in or left out still stands together.

Spans are verified by the words themselves: a vote counts only where both words equal the template's, and a span holds
where one diagonal has all of the template's words, or, for notices (NOTICE words or more), where the merged diagonals
have the share NEARLY of them. Of overlapping merged diagonals the fullest is reported, of equals the first.

Words are runs without ASCII characters other than letters and digits, lower-cased A-Z, numbered from 0. Null, empty and
wordless texts hold nothing. Repeated rows are rows of their own. All columns of the input come back inside `doc`. A text
is never gathered: its pairs are rows, dealt by text and template only where they hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.words import let
from barloom.plans.attach import BROADCAST_BYTES, table_bytes
from barloom.session import discard, written

SLACK, NOTICE, NEARLY = 3, 12, 0.8
#: Fixed values of the contract: label and phrase.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Published license statements and the opening words of published notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """A hash for each word and its follower."""
    return F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def template_positions(spark: SparkSession, templates=TEMPLATES, base=BASE) -> DataFrame:
    """(pair, template, label, is_base, t, a, b, size): one row for each pair of words of each template."""
    every = [(i, label, text, i < len(base)) for i, (label, text) in enumerate((*base, *templates))]
    if any(not 2 <= len(text.split()) <= 63 for _, _, text, _ in every):
        raise ValueError("templates have 2 to 63 words")
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(b).alias("is_base")) for i, label, text, b in every])
    each = spark.range(1).select(F.explode(rows).alias("r")).select("r.*").withColumn("w", words_of(F.col("text")))
    at = each.select("template", "label", "is_base", "w", F.size("w").alias("size"), F.posexplode(_pairs(F.col("w"))).alias("t", "pair")).filter(F.col("t") < F.col("size") - 1)
    return at.select("pair", "template", "label", "is_base", "t", F.get("w", F.col("t")).alias("a"), F.get("w", F.col("t") + 1).alias("b"), "size")


def _table(docs: DataFrame, text: str, templates, base) -> DataFrame:
    """A written table: each row of docs once, with `doc` without its text and n_words, and each verified vote."""
    spark = docs.sparkSession
    keep = [docs[c] for c in docs.columns if c != text]
    held = docs.select(F.monotonically_increasing_id().alias("row"), (F.struct(*keep) if keep else F.struct(F.lit(0).alias("_"))).alias("doc"), words_of(docs[text]).alias("w"))
    # the first element stands for the row itself
    pairs = held.select("row", "doc", "w", F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), let(F.col("w"), _pairs))).alias("at", "pair"))
    known = template_positions(spark, templates, base)
    if table_bytes(known) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    own = pairs["at"] == 0
    met = pairs.join(known, (pairs["pair"] == known["pair"]) & ~own, "left")
    same = (F.get("w", F.col("at") - 1) == F.col("a")) & (F.get("w", F.col("at")) == F.col("b"))
    return written(met.filter(own | same).select(
        "row", F.when(own, F.col("doc")).alias("doc"), F.when(own, F.size("w").cast("bigint")).alias("n_words"),
        "template", "label", "is_base", "size", "t", (F.col("at") - 1 - F.col("t")).cast("bigint").alias("diagonal"),
    ))


def _voted(table: DataFrame) -> DataFrame:
    """(row, template, label, is_base, diagonal, straight, merged, held): shares of the template's words on a diagonal and
    around it, and whether a span is verified there."""
    keys = ["row", "template"]
    votes = table.filter("template IS NOT NULL").groupBy(*keys, "label", "is_base", "size", "diagonal").agg(F.bit_or(F.expr("shiftleft(1L, t)")).alias("bits"))
    near = Window.partitionBy(*keys).orderBy("diagonal").rangeBetween(-SLACK, SLACK)
    share = lambda c: F.bit_count(c.bitwiseOR(F.shiftleft(c, 1))) / F.col("size")  # noqa: E731  words of the voting pairs
    merged = votes.withColumn("straight", share(F.col("bits"))).withColumn("_m", F.bit_or("bits").over(near))
    notice = F.col("size") >= NOTICE
    full = merged.withColumn("merged", F.when(notice, share(F.col("_m"))).otherwise(F.col("straight")))
    top = F.max(F.struct(F.col("merged"), F.col("straight"), -F.col("diagonal"))).over(near)
    whole = F.expr("bit_count(bits) = size - 1")
    peak = top == F.struct(F.col("merged"), F.col("straight"), -F.col("diagonal"))
    return full.withColumn("held", whole | (notice & (F.col("merged") >= NEARLY) & peak)).drop("_m", "bits")


def spans(docs: DataFrame, text: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """(doc, label, is_base, start, share): every verified span, by its first word."""
    table = _table(docs, text, templates, base)
    held = _voted(table).filter("held").select("row", "label", "is_base", F.col("diagonal").alias("start"), F.col("merged").alias("share"))
    out = written(table.filter("doc IS NOT NULL").select("row", "doc").join(held, "row").drop("row"))
    discard(table)
    return out


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """Every row as `doc` with n_words, n_base, first_word and last_word (verified base places, their least and greatest
    start), base_labels and labels (sorted arrays; `labels` has the further templates' too) and score, the greatest share of
    a template's words found together."""
    table = _table(docs, text, templates, base)
    held, of_base = F.col("held"), F.col("held") & F.col("is_base")
    found = _voted(table).groupBy("row").agg(
        F.count_if(of_base).alias("n_base"), F.min(F.when(of_base, F.col("diagonal"))).alias("first_word"), F.max(F.when(of_base, F.col("diagonal"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(of_base, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set(F.when(held, F.col("label")))).alias("labels"),
        F.max("merged").alias("score"),
    )
    none = F.array().cast("array<string>")
    rows = table.filter("doc IS NOT NULL").select("row", "doc", "n_words").join(found, "row", "left")
    out = written(rows.select(
        "doc", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    ))
    discard(table)
    return out
