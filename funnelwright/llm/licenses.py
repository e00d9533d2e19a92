"""License scans: phrases by place, and an exact set-similarity join of text blocks with license templates.

Everything is DataFrame and SQL functions. A text block is a run of 2 x step consecutive words that starts at a multiple of
step, where step is the template's length in words rounded up to a power of two (16 at least): any stretch as long as the
template lies whole in some block. A block has a template's label if it holds at least `THRESHOLD` of its distinct words.

1. The words of the templates are counted over the whole corpus (one line per template word reaches the driver) and put in
   one global order, rarest first.
2. Prefix filter: a block that holds `needed` of a template's words holds one of its first size - needed + 1 in that order.
   Only blocks with such a word are cut out of a text; no other word leaves its row.
3. The blocks' words are joined with the templates' prefixes on (step, word). Length filter: the block must have `needed`
   template words at all. Positional filter: with the first shared word at places p and q of the two ordered sets, the
   remaining words must suffice, 1 + min(size - p - 1, size of block - q - 1) >= needed. Each pair that is left is verified
   by intersection, once, at its first shared word. No pair above the threshold is lost.
4. Matches are grouped by text hash, summed map-side first, so copies of a text are one group, and joined back by it.

Memory is bounded by one text and its blocks (each word is in two blocks per step). Templates are a parameter of stated size;
their join is broadcast only where Spark's own size check allows it.

Defined cases: null text is empty and has no words, places or matches; repeated rows and rows with equal texts have equal
results; a null id is kept; a text of any length is read whole; an empty table gives an empty result. Added columns take a
leading underscore where the input already has their name.
"""

from __future__ import annotations

import re
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, free_name

THRESHOLD = 0.8
LEAST_STEP = 16
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that mark a license by themselves, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public license notices, by label.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "reserved": (
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the "
        "prior written permission of the publisher",
    ),
}


def text_words(text: str) -> list[str]:
    """The word rule, for the templates: A-Z lower-cased, other capitals as they are."""
    low = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return [w for w in re.split(SEPARATORS, low) if w]


def template_rows(templates: Mapping[str, Sequence[str]], threshold: float) -> list[dict]:
    """One entry per template: number, label, distinct words, step and words needed."""
    rows = []
    for label, texts in templates.items():
        for text in texts:
            found = text_words(text)
            if not found:
                raise ValueError("a template without words")
            step = LEAST_STEP
            while step < len(found):
                step *= 2
            words = sorted(set(found))
            needed = next(n for n in range(1, len(words) + 1) if n >= threshold * len(words) - 1e-9)
            rows.append({"template": len(rows), "label": label, "words": words, "step": step, "needed": needed})
    return rows


def words_of(text: Column) -> Column:
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(folded, SEPARATORS), "")


def _literal(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def word_order(df: DataFrame, vocabulary: Sequence[str], text_column: str = "text") -> list[str]:
    """The vocabulary, rarest word in the corpus first; ties by the word."""
    found = df.select(F.explode(F.filter(words_of(F.col(f"`{text_column}`")), lambda w: w.isin(*vocabulary))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def match_templates(keyed: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(k1, k2, matches) of every text with a match; keyed: (k1, k2, text), where equal texts have equal keys.

    matches: (template, label, start, containment) of each block that meets the threshold, by template and start.
    """
    rows = template_rows(templates, threshold)
    order = word_order(keyed, sorted({w for r in rows for w in r["words"]}))
    place = {w: i for i, w in enumerate(order)}
    index = []
    for r in rows:
        ordered = sorted(r["words"], key=place.__getitem__)
        for p, word in enumerate(ordered[: len(ordered) - r["needed"] + 1]):
            index.append((r["step"], word, p, r["template"], r["label"], r["needed"], ordered))
    prefixes = keyed.sparkSession.createDataFrame(
        index, "step int, word string, p int, template int, label string, needed int, ordered array<string>"
    )
    steps = {s: sorted({w for t, w, *_ in index if t == s}) for s in sorted({r["step"] for r in rows})}
    rare = sorted({w for words in steps.values() for w in words})

    def blocks(w: Column) -> Column:
        def at(places: Column) -> Column:
            return F.flatten(F.array(*[of_step(places, s, words) for s, words in steps.items()]))

        def of_step(places: Column, step: int, words: Sequence[str]) -> Column:
            own = F.filter(places, lambda i: F.get(w, i).isin(*words))
            last = F.greatest(F.ceil(F.size(w) / step).cast("int") - 2, F.lit(0))  # the block that reaches the end
            numbers = F.flatten(F.transform(own, lambda i: F.array(F.floor(i / step).cast("int") - 1, F.floor(i / step).cast("int"))))
            numbers = F.array_distinct(F.transform(numbers, lambda b: F.greatest(F.least(b, last), F.lit(0))))
            return F.transform(numbers, lambda b: F.struct(F.lit(step).alias("step"), (b * step).alias("start"), F.slice(w, b * step + 1, 2 * step).alias("words")))

        places = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(*rare), i)))
        return bound(places, at)

    cut = keyed.select("k1", "k2", F.explode(bound(words_of(F.col("text")), blocks)).alias("block"))
    # In the global order, since an intersection keeps the order of its first array.
    cut = cut.select("k1", "k2", "block.step", "block.start", F.array_intersect(_literal(order), "block.words").alias("held"))
    probe = cut.select("*", F.size("held").alias("n"), F.posexplode("held").alias("q", "word")).where(F.col("word").isin(*rare))
    size = F.size("ordered")
    enough = (F.col("n") >= F.col("needed")) & (1 + F.least(size - F.col("p") - 1, F.col("n") - F.col("q") - 1) >= F.col("needed"))
    pairs = probe.join(prefixes, ["step", "word"]).where(enough)
    shared = F.array_intersect("ordered", "held")
    pairs = pairs.where((F.get(shared, 0) == F.col("word")) & (F.size(shared) >= F.col("needed")))
    pairs = pairs.select("k1", "k2", "template", "label", "start", (F.size(shared) / size).alias("containment"))
    # Copies of a text fall together before its matches are gathered: at most blocks x templates of one text.
    pairs = pairs.groupBy("k1", "k2", "template", "label", "start").agg(F.max("containment").alias("containment"))
    return pairs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("template", "label", "start", "containment"))).alias("matches"))


def _places(w: Column, phrases: Mapping[str, str]) -> Column:
    """(start, label) of every place where a phrase's words stand consecutively."""

    def here(x: Column, i: Column) -> Column:
        found = []
        for phrase, label in phrases.items():
            first, *others = phrase.split()
            stands = x == first
            for j, other in enumerate(others, 1):
                stands = stands & F.coalesce(F.get(w, i + j) == other, F.lit(False))
            found.append(F.when(stands, F.struct(i.alias("start"), F.lit(label).alias("label"))))
        return F.when(x.isin(*{p.split()[0] for p in phrases}), F.array_compact(F.array(*found)))

    return F.flatten(F.array_compact(F.transform(w, here)))


def find_licenses(
    df: DataFrame,
    text_column: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """df plus n_words, places (start, label) and matches (template, label, start, containment)."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0, 1 at most")
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    keys = {"k1": F.xxhash64(text, F.lit(1)), "k2": F.xxhash64(F.lit(2), text)}
    matched = match_templates(df.select(*[v.alias(k) for k, v in keys.items()], text.alias("text")), templates, threshold)
    k1, k2, base = (free_name(df, c) for c in ("k1", "k2", "base"))
    joined, matches = free_name(df, "matched"), free_name(df, "matches")
    n_words, places = free_name(df, "n_words"), free_name(df, "places")
    scan = bound(words_of(F.col(f"`{text_column}`")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _places(w, phrases).alias("places")))
    out = df.withColumns({k1: keys["k1"], k2: keys["k2"], base: scan})
    out = out.join(matched.toDF(k1, k2, joined), [k1, k2], "left")
    empty = F.array().cast(matched.schema["matches"].dataType)
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col(base)["n"].alias(n_words),
        F.col(base)["places"].alias(places),
        F.coalesce(F.col(joined), empty).alias(matches),
    )
