"""License scan with DataFrame functions only.

Templates and documents are word n-grams (five words; a shorter template is one n-gram). Documents are read in windows
that overlap by half, of twice the n-grams of a class of template sizes (powers of two), so the place of a template lies
in one window as a whole. A window and a template share a MinHash in one of 64 bands of one row each with a probability
above 0.99999 where the window holds three quarters of the template; the pairs so found are verified by the exact
share of the template's n-grams in the window.

A window without any n-gram of a template can share no MinHash with one, so documents and windows without such
n-grams, nearly all of them, are left before their signatures are computed.

Cases: null and empty texts match nothing; long texts are read whole; rows of one id count as one document; rows without
an id are left out; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Usual license statements.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("All-rights-reserved", "All rights reserved."),
)
WORDS, BANDS, CONTAINED = 5, 64, 0.75
SPLIT = r"[^\p{L}\p{N}]+"


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), SPLIT), lambda w: w != "")


def grams(words: Column, n: int) -> Column:
    """64-bit hashes of all runs of n words in order."""
    count = F.size(words) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def signatures(items: Column) -> Column:
    """A MinHash of an array of hashes for each band, in the bands' order."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(items, lambda x: F.xxhash64(x, b))))


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns computed once: a generator of one row, through which Spark pushes no filter and copies no expression."""
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(template, license, n_words, grams, size, wide) of each template; wide: the n-grams of its windows."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    rows = rows.select("template", "license", words_of("text").alias("words"), F.least(F.size(words_of("text")), F.lit(WORDS)).alias("n_words"))
    own = F.lit(None).cast("array<bigint>")
    for n in range(1, WORDS + 1):
        own = F.when(F.col("n_words") == n, grams(F.col("words"), n)).otherwise(own)
    rows = rows.where("n_words > 0").select("template", "license", "words", "n_words", F.array_distinct(own).alias("grams"))
    rows = rows.withColumn("size", F.size("grams").cast("long"))
    return rows.withColumn("wide", F.pow(F.lit(2), F.ceil(F.log2("size")) + 1).cast("int"))


def scan_licenses(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, license, template, template_ngrams, matched_ngrams, windows, first_word) of each document and template found.

    matched_ngrams: most template n-grams in one window; windows: those that hold enough; first_word: the first one's start.
    """
    spark = documents.sparkSession
    known = template_table(spark, templates)
    # the template list is a parameter that the driver holds, so its classes are constants of the plan
    told = known.collect()
    classes = sorted({(r.n_words, r.wide) for r in told})
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = settled(rows, words=words_of("text")).drop("text")
    fields = []
    for n in sorted({n for n, _ in classes}):
        every = sorted({x for r in told if r.n_words == n for x in r.grams})
        wanted = F.array(*[F.lit(x) for x in every]).cast("array<bigint>")
        own = grams(F.col("words"), n)
        if n < WORDS:  # short templates match as a whole only: all their words are there
            some = F.lit(False)
            for r in told:
                if r.n_words == n:
                    some = some | (F.size(F.array_intersect(F.col("words"), F.array(*map(F.lit, sorted(set(r.words)))))) == len(set(r.words)))
            own = F.when(some, own).otherwise(F.array().cast("array<bigint>"))
        fields.append((n, own, wanted))
    rows = settled(rows, **{f"grams_{n}": own for n, own, _ in fields}).drop("words")
    rows = rows.where(" OR ".join(f"arrays_overlap(grams_{n}, array({', '.join(f'{x}L' for x in sorted({y for r in told if r.n_words == n for y in r.grams}))}))" for n, _, _ in fields))
    rows = written(rows, "licensed")  # the documents with any n-gram of a template, read once
    bands = known.select("template", "license", "n_words", "wide", "size", F.col("grams").alias("template_grams"), F.posexplode(signatures(F.col("grams"))).alias("band", "least"))
    found = None
    for n, wide in classes:
        wanted = F.array(*[F.lit(x) for x in sorted({y for r in told if (r.n_words, r.wide) == (n, wide) for y in r.grams})]).cast("array<bigint>")
        own = F.col(f"grams_{n}")
        step = max(1, wide // 2)
        windows = rows.where(F.size(own) > 0).select("doc_id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.size(own) - 1, F.lit(step))).alias("start"))
        windows = settled(windows, window=F.slice("own", F.col("start") + 1, wide)).drop("own").where(F.arrays_overlap("window", wanted))
        sketched = windows.select("doc_id", "start", "window", F.posexplode(signatures(F.col("window"))).alias("band", "least"))
        mine = bands.where((F.col("n_words") == n) & (F.col("wide") == wide))
        # as many rows as templates have bands: the list of templates is a parameter
        met = sketched.join(F.broadcast(mine), ["band", "least"]).groupBy("doc_id", "start", "template", "license", "size").agg(F.first("window").alias("window"), F.first("template_grams").alias("template_grams"))
        met = met.withColumn("matched", F.size(F.array_intersect("window", "template_grams")).cast("long")).where(F.col("matched") >= CONTAINED * F.col("size"))
        met = met.select("doc_id", "start", "template", "license", "size", "matched")
        found = met if found is None else found.unionByName(met)
    return found.groupBy("doc_id", "license", "template", F.col("size").alias("template_ngrams")).agg(
        F.max("matched").alias("matched_ngrams"), F.count("*").alias("windows"), F.min("start").cast("long").alias("first_word")
    )


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """DuckDB SQL for ``scan_licenses`` over ``documents``: containment of every window, without signatures."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(templates))
    words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
        WITH t0 AS (SELECT template, license, {words.format('text')} AS w FROM (VALUES {quoted}) AS v(template, license, text)),
        t1 AS (SELECT *, least(len(w), {WORDS}) AS n FROM t0 WHERE len(w) > 0),
        t2 AS (SELECT DISTINCT template, license, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM t1)),
        t3 AS (SELECT *, count(*) OVER (PARTITION BY template) AS size FROM t2),
        t4 AS (SELECT *, CAST(pow(2, ceil(log2(size)) + 1) AS BIGINT) AS wide FROM t3),
        d0 AS (SELECT DISTINCT doc_id, {words.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        d1 AS (SELECT doc_id, w, k.n, unnest(range(1, len(w) - k.n + 2)) AS i FROM d0, (SELECT DISTINCT n FROM t4) k WHERE len(w) >= k.n),
        d2 AS (SELECT doc_id, n, i - 1 AS pos, array_to_string(w[i : i + n - 1], ' ') AS gram FROM d1),
        h AS (SELECT d2.doc_id, d2.pos, t4.* FROM d2 JOIN t4 ON d2.n = t4.n AND d2.gram = t4.gram),
        x AS (SELECT *, greatest(1, CAST(floor(wide / 2) AS BIGINT)) AS step FROM h),
        y AS (SELECT *, CAST((floor(pos / step) - o) * step AS BIGINT) AS start FROM x, (VALUES (0), (1)) AS v(o) WHERE floor(pos / step) >= o),
        z AS (SELECT doc_id, license, template, size, start, count(DISTINCT gram) AS matched FROM y WHERE pos < start + wide GROUP BY ALL)
        SELECT doc_id, license, CAST(template AS INTEGER) AS template, CAST(size AS BIGINT) AS template_ngrams, CAST(max(matched) AS BIGINT) AS matched_ngrams,
               count(*) AS windows, CAST(min(start) AS BIGINT) AS first_word
        FROM z WHERE matched >= {CONTAINED} * size GROUP BY doc_id, license, template, size
    """
