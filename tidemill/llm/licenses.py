"""License scans: MinHash bands over overlapping text windows retrieve license templates; exact containment verifies them.

Templates are lists of five-word shingles, cut into sections no longer than the step between windows, so each whole
section of a text lies in one of two overlapping windows. Shingles that occur in no template cannot count towards the
containment of any, so windows are signed over their template shingles alone: that keeps the number of rows that leave the
scan low. Signatures are one-permutation MinHash: each of PERMUTATIONS hash functions deals shingles into BINS, and the
smallest hash of a bin is a band of one row. A shingle that window and section share makes them meet unless another one of
the two is smaller in its bin, under every permutation: they are retrieved with probability 1 - (m / (2 * BINS))^PERMUTATIONS
at least, with m other shingles in both. A window has at most WINDOW shingles and a section at most STEP, so that is
1 - 5e-6 for the shortest notice in the fullest window, and no template depends on what stands beside it.

Everything is DataFrame expressions; the text is scanned once and never shuffled. The template tables are constants of a
proven size (MAX_TEMPLATE_SHINGLES), and only these are broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import read, stored

SHINGLE = 5
THRESHOLD = 0.8
STEP = 32
WINDOW = 2 * STEP
PERMUTATIONS = 4
BINS = 1024
MAX_TEMPLATE_SHINGLES = 50_000
SPLIT = r"[^\p{L}\p{N}]+"

#: Short notices and first sentences of widely used licenses.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def collision_probability(others: int, bins: int = BINS, permutations: int = PERMUTATIONS) -> float:
    """The least probability with which a window and a section that share a shingle share a band; others: how many other
    shingles the two have."""
    return 1 - min(1.0, others / (2 * bins)) ** permutations


def template_sections(templates: dict[str, str]) -> list[tuple[str, int, list[list[str]]]]:
    """(template, section, shingles): shingles of a template in runs of at most STEP. Templates of under five words: none."""
    out = []
    for name, text in templates.items():
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        shingles = [words[i : i + SHINGLE] for i in range(len(words) - SHINGLE + 1)]
        out += [(name, i // STEP, shingles[i : i + STEP]) for i in range(0, len(shingles), STEP)]
    if sum(len(s) for _, _, s in out) > MAX_TEMPLATE_SHINGLES:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_SHINGLES} shingles: split the catalogue")
    return out


def _bands(shingles: DataFrame, *of: str) -> DataFrame:
    """The bands (permutation, bin, low) of each set of shingles; `of` names the columns that tell the sets apart."""
    hashed = F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS - 1)), lambda p: F.struct(p.alias("permutation"), F.xxhash64("shingle", p).alias("low")))
    each = shingles.select(*of, F.explode(hashed).alias("h")).select(*of, "h.permutation", F.pmod("h.low", F.lit(BINS)).alias("bin"), "h.low")
    return each.groupBy(*of, "permutation", "bin").agg(F.min("low").alias("low"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and template that it holds: doc_id, template_id, containment, first_word.

    containment: of the template's distinct five-word shingles, the share that one window holds (by section, then summed);
    rows have threshold or more. first_word: words before the first shingle of that template in the document. Null and
    empty texts, and texts under five words, hold nothing; an empty table gives an empty result. Documents that share an
    id are scanned as one. Case and punctuation don't count.
    """
    spark = docs.sparkSession
    sections = template_sections(TEMPLATES if templates is None else templates)
    flat = [(t, s, *sh) for t, s, shingles in sections for sh in {tuple(x): None for x in shingles}]
    parts = ", ".join(f"w{i} string" for i in range(SHINGLE))
    table = spark.createDataFrame(flat, f"template_id string, section int, {parts}").select("template_id", "section", F.xxhash64(*[f"w{i}" for i in range(SHINGLE)]).alias("shingle")).distinct()
    known = [r[0] for r in table.select("shingle").distinct().collect()]

    words = F.filter(F.split(F.lower("text"), SPLIT), lambda w: w != "")
    at = docs.select("doc_id", words.alias("words"))

    def hashed(i):
        return F.xxhash64(*[F.get("words", i + j) for j in range(SHINGLE)])

    places = F.filter(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda i: hashed(i).isin(known))
    hits = at.filter(F.size("words") >= SHINGLE).select("doc_id", F.explode(F.transform(places, lambda i: F.struct(i.alias("word"), hashed(i).alias("shingle")))).alias("hit")).select("doc_id", "hit.*")
    hits = stored(hits, "license-hits")
    step = F.floor(F.col("word") / STEP)
    windows = hits.withColumn("window", F.explode(F.when(step > 0, F.array(step, step - 1)).otherwise(F.array(step)))).select("doc_id", "window", "shingle").distinct()
    keyed = _bands(table, "template_id", "section")
    found = _bands(windows, "doc_id", "window").join(F.broadcast(keyed), ["permutation", "bin", "low"]).select("doc_id", "template_id").distinct()
    windows = windows.groupBy("doc_id", "window").agg(F.collect_set("shingle").alias("shingles"))
    of_templates = table.groupBy("template_id", "section").agg(F.collect_set("shingle").alias("shingles"))

    # the exact check: every window of a retrieved document against every section of the retrieved template
    by_template = of_templates.groupBy("template_id").agg(F.collect_list(F.struct("section", "shingles")).alias("sections"), F.sum(F.size("shingles")).alias("total"))
    held = found.join(windows, found.doc_id.eqNullSafe(windows.doc_id)).select(found.doc_id, "template_id", F.col("shingles").alias("in_window")).join(F.broadcast(by_template), "template_id")
    matched = held.select("doc_id", "template_id", "total", F.explode(F.transform("sections", lambda s: F.struct(s["section"].alias("section"), F.size(F.array_intersect(s["shingles"], F.col("in_window"))).alias("n")))).alias("m"))
    best = matched.groupBy("doc_id", "template_id", "total", "m.section").agg(F.max("m.n").alias("n")).groupBy("doc_id", "template_id", "total").agg(F.sum("n").alias("n"))
    whole = best.select("doc_id", "template_id", (F.col("n") / F.col("total")).alias("containment")).filter(F.col("containment") >= threshold)
    first = hits.join(F.broadcast(table.select("template_id", "shingle").distinct()), "shingle").groupBy("doc_id", "template_id").agg(F.min("word").alias("first_word"))
    return whole.join(first, whole.doc_id.eqNullSafe(first.doc_id) & (whole.template_id == first.template_id)).select(whole.doc_id, whole.template_id, "containment", F.col("first_word").cast("long").alias("first_word"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    rows = ", ".join(f"('{t}', {s}, '{' '.join(sh)}')" for t, s, shingles in template_sections(TEMPLATES) for sh in {tuple(x): None for x in shingles})
    return f"""
WITH t(template_id, section, shingle) AS (SELECT DISTINCT * FROM (VALUES {rows})),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {SHINGLE - 1})) AS word FROM w WHERE len(ws) >= {SHINGLE}),
h AS (SELECT doc_id, word, array_to_string(ws[word + 1 : word + {SHINGLE}], ' ') AS shingle FROM p),
hits AS (SELECT * FROM h WHERE shingle IN (SELECT shingle FROM t)),
win AS (SELECT DISTINCT doc_id, word // {STEP} - d AS win, shingle FROM hits, (VALUES (0), (1)) v(d) WHERE word // {STEP} - d >= 0),
m AS (SELECT doc_id, template_id, section, win, count(*) AS n FROM win JOIN t USING (shingle) GROUP BY ALL),
b AS (SELECT doc_id, template_id, section, max(n) AS n FROM m GROUP BY ALL),
s AS (SELECT doc_id, template_id, sum(n) AS n FROM b GROUP BY ALL),
tot AS (SELECT template_id, count(*) AS total FROM t GROUP BY ALL),
f AS (SELECT doc_id, template_id, min(word) AS first_word FROM hits JOIN t USING (shingle) GROUP BY ALL)
SELECT s.doc_id, s.template_id, CAST(n AS DOUBLE) / total AS containment, CAST(first_word AS BIGINT) AS first_word
FROM s JOIN tot USING (template_id) JOIN f ON f.doc_id = s.doc_id AND f.template_id = s.template_id
WHERE CAST(n AS DOUBLE) / total >= {THRESHOLD}"""


ORACLE = _oracle()
