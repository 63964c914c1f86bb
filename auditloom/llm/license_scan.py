"""License scans: phrases at word positions and an exact containment join with notice templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_of

# Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short public notices of well-known licenses, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "copyright": "copyright all rights reserved",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "public-domain": "this is free and unencumbered software released into the public domain",
}

_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced_words(text: Column) -> Column:
    """The words of a text, A-Z in lower case, with one space between any two."""
    return F.btrim(F.regexp_replace(ascii_lower(text), _DELIMITERS, " "))


def _n_words(spaced: Column) -> Column:
    return F.when(spaced == "", F.lit(0)).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)


def _words_in(chars: Column) -> Column:
    """Whole words in a string where each word has a space of its own on either side."""
    return ((F.length(chars) - F.length(F.replace(chars, F.lit(" "), F.lit("")))) / 2).cast("long")


def phrase_places(spaced: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Count, first and last start (in words) of a phrase; 0 and nulls where it doesn't stand.

    Each word gets a space of its own on either side, so that neighbouring places don't share a character.
    """
    own, look = F.concat(F.lit(" "), F.replace(spaced, F.lit(" "), F.lit("  ")), F.lit(" ")), f" {phrase.replace(' ', '  ')} "
    there = F.contains(F.concat(F.lit(" "), spaced, F.lit(" ")), F.lit(f" {phrase} "))
    left = F.replace(own, F.lit(look), F.lit(""))
    count = F.when(there, ((F.length(own) - F.length(left)) / len(look)).cast("long")).otherwise(F.lit(0).cast("long"))
    first = F.when(there, _words_in(F.substring_index(own, look, 1)))
    after = _words_in(F.substring_index(own, look, -1))
    last = F.when(there, _n_words(spaced).cast("long") - after - len(phrase.split()))
    return count, first, last


def template_tokens(templates: dict[str, str]) -> dict[str, list[str]]:
    """Distinct words of each template."""
    return {label: sorted({w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()}) for label, text in templates.items()}


def spans_of(templates: dict[str, str]) -> dict[str, int]:
    """The words of a text block for each template: twice its own and a dozen, for names, years and marks between them."""
    return {label: 2 * len("".join(c if c.isalnum() else " " for c in text).split()) + 12 for label, text in templates.items()}


def token_counts(spaced: DataFrame, vocabulary: list[str], words: str = "_words") -> DataFrame:
    """In how many documents each word of the templates stands; at most len(vocabulary) rows."""
    found = F.array_intersect(F.col(words), F.array(*map(F.lit, vocabulary)))
    return spaced.select(F.explode(found).alias("token")).groupBy("token").count()


def template_matches(df: DataFrame, id_col: str, text_col: str, templates: dict[str, str] = TEMPLATES, containment: float = 0.9) -> DataFrame:
    """Every (id, label, containment) where a text block holds at least that share of a template's distinct words.

    Blocks are all runs of spans_of() words of the text, whatever its line ends. Each run lies in one of the parts that
    start at every multiple of the longest span and are twice as long. Words are put in the order of their document
    frequency over the whole table (rarest first, ties by word). A block that holds at least ceil(c * t) of a template's
    t words holds one of its t - ceil(c * t) + 1 rarest: only parts with such a word are opened (prefix filter), only
    those with enough words (length filter) and with enough of the template's words from there on (positional filter)
    have their blocks compared. The templates are a parameter and the index over them has at most as many rows as they
    have words.
    """
    tokens = template_tokens(templates)
    need = {label: math.ceil(containment * len(t) - 1e-9) for label, t in tokens.items()}
    vocabulary = sorted({t for ts in tokens.values() for t in ts})
    base = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    counted = {r["token"]: r["count"] for r in token_counts(base.select(F.split(spaced_words(F.col("_text")), " ").alias("_words")), vocabulary).collect()}
    ordered = {label: sorted(t, key=lambda w: (counted.get(w, 0), w)) for label, t in tokens.items()}
    index = [(w, label, k) for label, t in ordered.items() for k, w in enumerate(t[: len(t) - need[label] + 1]) if counted.get(w, 0)]
    spark = df.sparkSession
    if not index:
        return base.select("_id", F.lit("").alias("label"), F.lit(0.0).alias("containment")).where(F.lit(False))
    prefixes = F.array(*(F.lit(w) for w in sorted({w for w, _, _ in index})))
    spans = spans_of(templates)
    longest = max(spans.values())
    starts = F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / longest).cast("int"))
    parts = (
        base.where(F.rlike(F.lower("_text"), F.lit("|".join(sorted({w for w, _, _ in index})))))
        .select("_id", F.split(spaced_words(F.col("_text")), " ").alias("_all"))
        .select("_id", F.explode(F.transform(starts, lambda k: F.slice("_all", k * longest + 1, 2 * longest))).alias("_part"))
        .where(F.arrays_overlap("_part", prefixes))
        .select("_id", "_part", F.array_distinct("_part").alias("_words"))
        .select("_id", "_part", "_words", F.explode(F.array_intersect("_words", prefixes)).alias("token"))
    )
    columns = "token string, label string, place int"
    looked = parts.join(F.broadcast(spark.createDataFrame(index, columns)), "token")
    sets = F.create_map(*(x for label, t in ordered.items() for x in (F.lit(label), F.array(*map(F.lit, t)))))
    least = F.create_map(*(x for label in ordered for x in (F.lit(label), F.lit(need[label]))))
    sizes = F.create_map(*(x for label, t in ordered.items() for x in (F.lit(label), F.lit(len(t)))))
    widths = F.create_map(*(x for label in ordered for x in (F.lit(label), F.lit(spans[label]))))
    blocks = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_part") - F.col("_span") + 1))
    held = lambda at: F.size(F.array_intersect(F.slice("_part", at, F.col("_span")), F.col("_set")))
    rest = F.size(F.array_intersect("_words", F.slice(sets[F.col("label")], F.col("place") + 1, sizes[F.col("label")])))
    return (
        looked.where(F.size("_words") >= least[F.col("label")])
        .where(sizes[F.col("label")] - F.col("place") >= least[F.col("label")])
        .where(rest >= least[F.col("label")])
        .select("_id", "label", "_part", sets[F.col("label")].alias("_set"), least[F.col("label")].alias("_least"), widths[F.col("label")].alias("_span"))
        .select("_id", "label", "_least", F.size("_set").alias("_of"), F.array_max(F.transform(blocks, held)).alias("_held"))
        .where(F.col("_held") >= F.col("_least"))
        .select("_id", "label", (F.col("_held") / F.col("_of")).alias("containment"))
        .groupBy("_id", "label")
        .agg(F.max("containment").alias("containment"))
    )


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, containment: float = 0.9) -> DataFrame:
    """One row per input row: n_words, places of the base phrases, labels of both methods, and a score.

    score is the largest containment of a template, or 1 where a base phrase stands, or 0. Null text is empty and has
    no word. Ids should be unique: rows that repeat an id share the labels that the template join found for it. Other
    columns are ignored. Line ends are word limits like any other, so wrapped notices are found, and words scattered over a long line
    are no notice.
    """
    spaced = df.select(F.col(id_col).alias("_id"), spaced_words(text_of(text_col)).alias("_s"))
    places = {label: phrase_places(F.col("_s"), phrase) for phrase, label in PHRASES.items()}
    base = spaced.select(
        "_id",
        _n_words(F.col("_s")).cast("long").alias("n_words"),
        sum((c for c, _, _ in places.values()), F.lit(0).cast("long")).alias("n_base"),
        F.least(*(f for _, f, _ in places.values())).alias("first_word"),
        F.greatest(*(x for _, _, x in places.values())).alias("last_word"),
        F.array_sort(F.filter(F.array(*(F.when(c > 0, F.lit(label)) for label, (c, _, _) in places.items())), lambda x: x.isNotNull())).alias("_base"),
    )
    found = template_matches(df, id_col, text_col, templates, containment)
    found = found.groupBy(F.col("_id").alias("_found")).agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_score"))
    more = F.coalesce(F.col("_more"), F.array().cast("array<string>"))
    return base.join(found, F.col("_id") == F.col("_found"), "left").select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
