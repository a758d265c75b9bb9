"""License scans with MinHash bands over overlapping windows, in DataFrame operations only.

Texts are cut into words (runs of ASCII letters and digits, lower case) and two-word shingles. For
every length class of templates, windows of a fixed number of words overlap by half, at least
twice as long as the class's longest template, so that one window holds any occurrence whole.
``BANDS`` MinHash values of a window, one row to a band, are looked up among those of the templates;
a window that shares the share s of its shingles with a template collides with probability
1 - (1 - s)^BANDS. A window holds at most ``SPREAD`` times the words of its shortest template, so s
is at least ``CONTAINMENT / SPREAD``, about 0.21, and the probability at least 0.9999
(``collision_probability``). What collides is verified: the share of the template's distinct
shingles that the window holds must reach ``CONTAINMENT``.

Windows with fewer template shingles than the smallest template of their class needs can't pass
verification and get no MinHash.

Defined cases: a null, empty or one-word text matches nothing; repeated rows give the rows of each;
matches of several templates are all reported; an empty table gives an empty result. Only the id
and text columns are read. Templates are few by nature; more than ``MAX_SHINGLES`` are refused.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.text import bind
from timberline.llm.common import lower_ascii

BANDS = 40
CONTAINMENT = 0.8
SPREAD = 3.8  # bound of (window's words) / (words of a template of its class)
MAX_SHINGLES = 20_000

# Notices by which licenses are named, from the licenses' own texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("proprietary", "All rights reserved."),
)


def collision_probability(share: float, bands: int = BANDS) -> float:
    return 1 - (1 - share) ** bands


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def _shingles(words: Column) -> Column:
    """Hashes of neighbouring words, by position; none for fewer than two words."""

    def of(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
        return F.when(F.size(w) >= 2, pairs).otherwise(F.array().cast("array<bigint>"))

    return bind(words, of)


def _minhash(shingles: Column, bands: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b))),
    )


def _length_class(n: int) -> int:
    """Step of the windows: at least a template's words, growing by the root of two."""
    return math.ceil(4 * 2 ** (max(0, math.ceil(math.log2(n / 4) * 2)) / 2))


def license_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT,
    bands: int = BANDS,
) -> DataFrame:
    """(doc_id, license, template, first_word, n_words, containment) of every window with a verified template."""
    spark: SparkSession = docs.sparkSession
    made = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, text string")
    made = made.select(
        "template", "license", F.size(_words(F.col("text"))).alias("n"), F.array_distinct(_shingles(_words(F.col("text")))).alias("own")
    ).where(F.size("own") > 0)
    known = made.collect()  # as many rows as templates
    if sum(len(r.own) for r in known) > MAX_SHINGLES:
        raise ValueError(f"templates with more than {MAX_SHINGLES} shingles")
    classes = defaultdict(list)
    for r in known:
        classes[_length_class(r.n)].append(r)
    every = sorted({x for r in known for x in r.own})

    def starts(hit: Column, step: int, least: int) -> Column:
        """Windows in which ``least`` template shingles may stand: those around that many hits in a row."""
        dense = F.filter(hit, lambda x, k: F.get(hit, k + least - 1) - x < 2 * step - 1)
        numbers = F.flatten(F.transform(dense, lambda x: F.array(F.floor(x / step), F.floor(x / step) - 1)))
        own = F.array_distinct(F.filter(numbers, lambda b: b >= 0))
        return F.transform(own, lambda b: F.struct(F.lit(step).alias("step"), (b * step).cast("int").alias("start")))

    def windows(shingles: Column) -> Column:
        marked = F.transform(shingles, lambda x, i: F.when(x.isin(every), i))
        hits = F.filter(marked, lambda x: x.isNotNull())

        def around(hit: Column) -> Column:
            places = F.concat(
                *(starts(hit, step, max(1, min(math.ceil(len(r.own) * containment - 1e-9) for r in rows))) for step, rows in classes.items())
            )
            return F.transform(
                places,
                lambda w: F.struct(w["step"].alias("step"), w["start"].alias("start"), F.slice(shingles, w["start"] + 1, 2 * w["step"] - 1).alias("shingles")),
            )

        return bind(hits, around)

    # one expression, so that nothing of it is evaluated twice
    at = docs.select(docs[id_col].alias("doc_id"), F.explode(bind(_shingles(_words(docs[text_col])), windows)).alias("w")).select("doc_id", "w.*")
    at = at.withColumn("values", _minhash(F.col("shingles"), bands))
    banded = at.select("doc_id", "step", "start", "shingles", F.posexplode("values").alias("band", "value"))
    steps = F.create_map(*(F.lit(x) for r in known for x in (r.template, _length_class(r.n))))
    lookup = made.select(
        "template", "license", "own", steps[F.col("template")].alias("step"), F.posexplode(_minhash(F.col("own"), bands)).alias("band", "value")
    )
    share = F.size(F.array_intersect("own", "shingles")) / F.size("own")
    return (
        banded.join(lookup, ["step", "band", "value"])
        .withColumn("containment", share)
        .where(F.col("containment") >= containment)
        .select("doc_id", "license", "template", F.col("start").alias("first_word"), (2 * F.col("step")).alias("n_words"), "containment")
        .distinct()
    )


def licenses(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, license, n_windows, containment, first_word) for every license found in a document."""
    return license_windows(docs, **options).groupBy("doc_id", "license").agg(
        F.countDistinct("first_word", "n_words").alias("n_windows"),
        F.max("containment").alias("containment"),
        F.min("first_word").cast("bigint").alias("first_word"),
    )
