"""License scan: an exact set-similarity join of text blocks and templates, in DataFrame functions only."""

from __future__ import annotations

import math
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import settle

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases with their labels, and wordings of license notices with theirs.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("creative-commons", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
CONTAINMENT = 0.8


def _needed(templates: Sequence[tuple[str, str]], least: float) -> list[tuple[int, str, list[str], int]]:
    """(number, label, distinct tokens, tokens that must be there) of every template."""
    out = []
    for i, (label, wording) in enumerate(templates):
        tokens = sorted(set(wording.split()))
        out.append((i, label, tokens, math.ceil(least * len(tokens) - 1e-9)))
    return out


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _words(text: Column) -> Column:
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    line = F.trim(F.regexp_replace(low, GAP, " "))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def _template_array(needed, df: Mapping[str, int]) -> Column:
    """Structs of label, tokens, needed number and prefix: the rarest tokens, one of which every block found must hold."""
    out = []
    for _, label, tokens, need in needed:
        rarest = sorted(tokens, key=lambda t: (df.get(t, 0), t))[:len(tokens) - need + 1]
        out.append(F.struct(F.lit(label).alias("label"), _texts(tokens).alias("tokens"), F.lit(need).alias("need"), _texts(rarest).alias("prefix")))
    return F.array(*out)


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
         least: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    A block of a template with n distinct tokens is 2n consecutive words, or a
    whole shorter text; a template is found if a block holds ``least`` of its
    tokens, wherever the block begins and whatever other documents hold.  Three
    filters leave out only what cannot be found.  Tokens have one order, rarest in
    documents first, and a block with enough of a template's tokens holds one of
    its first ``n - needed + 1``, so documents without those are left out (prefix).  A
    document must hold enough of the tokens at all (length), and as many of their
    places as are needed must lie within a block's reach (position).  ``score`` is
    the largest share of a found template's tokens in a block, 1 where a phrase
    stands, else 0.  A null text is empty and has no words; very long texts are
    read whole; repeated rows give equal rows; tokens of equal frequency are
    ordered by spelling, which no result depends on; other columns are ignored; an
    empty table gives no rows.
    """
    needed = _needed(templates, least)
    vocabulary = sorted({t for _, _, tokens, _ in needed for t in tokens})
    first = docs.select("doc_id", _words(F.coalesce("text", F.lit(""))).alias("words"))
    first = first.select("doc_id", "words", F.array_intersect("words", _texts(vocabulary)).alias("held"))
    enough = F.lit(False)
    for _, _, tokens, need in needed:
        enough = enough | (F.size(F.array_intersect("held", _texts(tokens))) >= need)
    likely = F.lit(False)
    for phrase in phrases:
        likely = likely | F.forall(_texts(phrase.split()), lambda w: F.array_contains(F.col("words"), w))
    placed = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    known = F.filter(placed, lambda m: m["word"].isin(vocabulary))
    read = settle(first.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.size("words").cast("long").alias("n_words"),
                               F.when(F.size("held") > 0, F.col("held")).alias("held"), F.when(likely, F.col("words")).alias("words"),
                               F.when(enough, known).alias("known"), likely.alias("likely")), "read")

    # phrases: every word stands between two spaces of its own, so places that share no word do not overlap
    some = read.filter("likely").select("rid", F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")).alias("line"))
    places, hits, labels = F.lit(0), [], []
    for phrase, label in phrases.items():
        held = F.lit(f" {phrase.replace(' ', '  ')} ")
        n = ((F.length("line") - F.length(F.replace("line", held, F.lit("")))) / F.length(held)).cast("long")
        begin = F.instr("line", f" {phrase.replace(' ', '  ')} ")
        end = F.length("line") + 2 - F.instr(F.reverse("line"), f" {phrase.replace(' ', '  ')} "[::-1]) - F.length(held)
        places = places + n
        for at in (begin, end):
            before = F.substring(F.col("line"), F.lit(1), at)  # its length in words: each gap before is two spaces
            hits.append(F.when(begin > 0, ((F.length(before) - F.length(F.replace(before, F.lit("  "), F.lit("")))) / 2).cast("long")))
        labels.append(F.when(begin > 0, F.lit(label)))
    base = (some.select("rid", places.alias("n_base"), F.array_compact(F.array(*hits)).alias("at"),
                        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"))
            .filter(F.col("n_base") > 0)
            .select(F.col("rid").alias("brid"), "n_base", F.array_min("at").alias("first_word"), F.array_max("at").alias("last_word"), "base"))

    counted = read.select(F.explode("held").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    df = {r["token"]: r["df"] for r in counted.collect()}  # at most one row per token of the templates
    listed = _template_array(needed, df)
    held = F.col("held")
    near = F.filter(listed, lambda t: F.arrays_overlap(held, t["prefix"]) & (F.size(F.array_intersect(held, t["tokens"])) >= t["need"]))
    pairs = read.filter(F.col("known").isNotNull()).select("rid", "known", F.inline(near))
    places = F.transform("known", lambda m: F.struct(m["pos"].alias("pos"), F.array_position("tokens", m["word"]).alias("token")))
    found = pairs.select("rid", "label", "need", F.size("tokens").alias("size"), F.filter(places, lambda m: m["token"] > 0).alias("at"))

    def tokens_from(i: Column) -> Column:
        """Distinct tokens in the block that begins at the i-th place, where enough places lie within it."""
        end = F.get("at", i)["pos"] + 2 * F.col("size")
        block = F.filter(F.slice("at", i + 1, 2 * F.col("size")), lambda m: m["pos"] < end)
        return F.when(F.get("at", i + F.col("need") - 1)["pos"] < end, F.size(F.array_distinct(F.transform(block, lambda m: m["token"]))))

    begins = F.sequence(F.lit(0), F.greatest(F.size("at") - F.col("need"), F.lit(0)))
    best = found.select("rid", "label", "need", "size", F.array_max(F.transform(begins, tokens_from)).alias("n"))
    method = best.filter(F.col("n") >= F.col("need")).groupBy(F.col("rid").alias("mrid")).agg(
        F.collect_set("label").alias("method"), F.max(F.col("n") / F.col("size")).alias("share"))

    none = F.array().cast("array<string>")
    out = read.drop("words", "held", "known").join(base, F.col("rid") == F.col("brid"), "left").join(method, F.col("rid") == F.col("mrid"), "left")
    every = F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("method", none)))
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                      F.array_join(F.coalesce("base", none), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
                      F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).cast("double").alias("score"))


def oracle(phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = CONTAINMENT) -> str:
    needed = _needed(templates, least)
    rows = ", ".join(f"({i}, '{label}', {tokens!r}, {need})" for i, label, tokens, need in needed)
    named = ", ".join(f"({p.split()!r}, '{label}')" for p, label in phrases.items())
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return rf"""
WITH t(t, label, tokens, need) AS (VALUES {rows}), b(phrase, label) AS (VALUES {named}),
     w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
           FROM documents),
     p AS (SELECT doc_id, words, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM w),
     base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base
              FROM p JOIN b ON p.word = b.phrase[1] AND p.words[p.pos + 1:p.pos + len(b.phrase)] = b.phrase GROUP BY doc_id),
     k AS (SELECT t, label, need, len(tokens) AS size, unnest(tokens) AS token FROM t),
     m AS (SELECT doc_id, label, need, size, count(DISTINCT token) OVER (
             PARTITION BY doc_id, t ORDER BY pos RANGE BETWEEN CURRENT ROW AND 2 * size - 1 FOLLOWING) AS n
           FROM p JOIN k ON word = token),
     method AS (SELECT doc_id, list(DISTINCT label) AS method, max(n / size) AS share FROM m WHERE n >= need GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(method, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)
"""
