"""License scan: MinHash bands over overlapping windows, then exact shingle containment.

Words are runs of letters and digits, lower-cased; shingles are five words in a
row. A template is filed by windows of its shingles, as many as fit it: 1, 4 or
16. A document is cut into windows of the same sizes, overlapping by half (those
of one shingle at every place), and each window has a minimum per band over its
shingles. Bands are single minima, so windows of Jaccard similarity s meet with
probability 1 - (1 - s) ** BANDS, and equal windows always. Where a window meets
one of a template, the share of the template's shingles around it is counted.
Built-in SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.llm.texts import only

SHINGLE = 5
LEAST = 0.8
SIZES = ((1, 1), (4, 2), (16, 8))  # shingles of a window, step between windows
BANDS = 4
# Seeds of the bands: minima of the hashes after an exclusive or with each.
SEEDS = (0x0, 0x5555AAAA5A5AA5A5, -0x5A5A0F0F33CC33CC, -0x1234567890ABCDEF)
BLOCK = 50_000
SLACK = 8
# Notices as their publishers word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# Every ASCII character that is no letter or digit, one by one: the JVM reads such a class through a bit table.
SEPARATORS = "[" + "".join(f"\\x{b:02x}" for b in range(128) if not chr(b).isalnum()) + "]+"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingle_hashes(words: Column) -> Column:
    """A hash per five words in a row; none for fewer words."""
    at = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    each = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(F.size(words) >= SHINGLE, each).otherwise(F.array().cast("array<bigint>"))


def _minimum(hashes: Column, at: Column, size: int, band: int) -> Column:
    """The band's minimum over a window that starts at shingle `at`, from 1."""
    if size == 1:
        return F.get(hashes, at - 1)
    return F.array_min(F.transform(F.slice(hashes, at, size), lambda h: h.bitwiseXOR(F.lit(SEEDS[band]))))


def _starts(hashes: Column, size: int, step: int) -> Column:
    """Window starts from 1, the last window at the end."""
    last = F.size(hashes) - size + 1
    regular = F.sequence(F.lit(1), last, F.lit(step))
    return F.when(last >= 1, F.array_union(regular, F.array(last)) if step > 1 else regular)


def window_size(shingles: int) -> int:
    """The largest window that lies whole in any template-long run, wherever the windows start."""
    return max(size for size, step in SIZES if size + step - 1 <= max(1, shingles))


def _template_windows(spark, templates: tuple[tuple[str, str], ...]) -> list[dict]:
    """license, shingles and, for every window of each template, its keys."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "template int, license string, text string")
    found = rows.select("template", "license", shingle_hashes(word_list(F.col("text"))).alias("h")).collect()
    out = []
    for r in found:
        if not r["h"]:
            raise ValueError(f"a template of {r['license']} has fewer than {SHINGLE} words")
        size = window_size(len(r["h"]))
        bands = range(BANDS) if size > 1 else range(1)
        signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
        mixed = lambda h, b: signed((h ^ SEEDS[b]) & (1 << 64) - 1) if size > 1 else h  # noqa: B023, E731
        for offset in range(len(r["h"]) - size + 1):
            for band in bands:
                key = min(mixed(h, band) for h in r["h"][offset : offset + size])
                out.append({"template": r["template"], "license": r["license"], "h": r["h"], "size": size, "band": band, "offset": offset, "key": key})
    return out


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, containment, position, places: one row per document id and license found.

    containment is the best share of a template's distinct shingles in one
    place, position where the leftmost place with at least `least` begins (its
    first matching shingle tells which word of the template stands there), and
    places how many there are: starts of a template closer together than its
    length, SLACK at most, are one place. Null or short texts match nothing;
    rows of one id count together. Templates need five words; they are taken
    in blocks, one scan each, so that a task's key set is bounded.
    """
    spark = docs.sparkSession
    windows = _template_windows(spark, templates)
    blocks = [windows[i : i + BLOCK] for i in range(0, len(windows), BLOCK)]
    base = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), word_list(F.col("text")).alias("words")
    )
    hashed = base.select("doc_id", shingle_hashes(F.col("words")).alias("h"))
    parts = [_block_places(hashed, block, least) for block in blocks]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # What a template's windows found in one document: a few starts for each place.
    starts = found.groupBy("row", "doc_id", "license", "template", "apart").agg(
        F.max("containment").alias("containment"), F.sort_array(F.collect_set("position")).alias("starts")
    )

    def add(seen: Column, start: Column) -> Column:
        fresh = start - seen["last"] >= F.col("apart")
        return F.struct(start.alias("last"), (seen["places"] + fresh.cast("bigint")).alias("places"))

    none = F.struct(F.lit(-(1 << 20)).cast("int").alias("last"), F.lit(0).cast("bigint").alias("places"))
    places = F.aggregate("starts", none, add, lambda seen: seen["places"])
    return (
        starts.select("doc_id", "license", "containment", F.get("starts", F.lit(0)).alias("position"), places.alias("places"))
        .groupBy("doc_id", "license")
        .agg(
            F.max("containment").alias("containment"),
            F.min("position").cast("bigint").alias("position"),
            F.sum("places").alias("places"),
        )
    )


def _block_places(hashed: DataFrame, windows: list[dict], least: float) -> DataFrame:
    spark = hashed.sparkSession
    h = F.col("h")
    reach = max(len(w["h"]) for w in windows) + SLACK
    met = []
    for size, step in SIZES:
        for band in range(BANDS if size > 1 else 1):
            keys = sorted({w["key"] for w in windows if (w["size"], w["band"]) == (size, band)})
            if keys:
                hit = lambda i: _minimum(h, i, size, band).isin(keys)  # noqa: B023, E731
                found = F.filter(_starts(h, size, step), hit)
                near = lambda i: F.struct(
                    F.lit(size).alias("size"),  # noqa: B023
                    F.lit(band).alias("band"),  # noqa: B023
                    i.alias("at"),
                    _minimum(h, i, size, band).alias("key"),  # noqa: B023
                    F.greatest(i - reach, F.lit(1)).alias("low"),
                    F.slice(h, F.greatest(i - reach, F.lit(1)), 2 * reach + size).alias("near"),  # noqa: B023
                )
                met.append(F.coalesce(F.transform(found, near), F.array()))
    named = hashed.withColumn("row", F.monotonically_increasing_id())
    candidates = named.select("row", "doc_id", F.explode(F.concat(*met)).alias("w")).select("row", "doc_id", "w.*")
    filed = spark.createDataFrame(
        [(w["template"], w["license"], w["h"], w["size"], w["band"], w["offset"], w["key"]) for w in windows],
        "template int, license string, shingles array<bigint>, size int, band int, offset int, key bigint",
    )
    start = F.col("at") - F.col("offset")
    begin = F.greatest(start - SLACK, F.col("low"))
    region = F.slice("near", begin - F.col("low") + 1, F.size("shingles") + 2 * SLACK)
    share = F.size(F.array_intersect("shingles", region)) / F.size(F.array_distinct("shingles"))
    # Which start each matching shingle of the region stands for; the first one near the guess tells where the place begins.
    meant = F.transform(
        region, lambda shingle, i: F.when(F.array_contains("shingles", shingle), begin + i - F.array_position("shingles", shingle).cast("int"))
    )
    apart = F.least(F.lit(SLACK), F.size("shingles") + SHINGLE - 2) + 1
    near = lambda other: F.get(F.filter(meant, lambda m: m.isNotNull() & (F.abs(m - other) < apart)), F.lit(0))
    anchored = near(F.col("guessed"))
    return (
        candidates.join(filed, ["size", "band", "key"])
        .withColumn("guessed", start - 1)
        .withColumn("guessed", anchored)
        .select(
            "row", "doc_id", "license", "template", apart.alias("apart"),
            F.when(anchored.isNotNull(), F.greatest(anchored, F.lit(0))).alias("position"), share.alias("containment"),
        )
        .where((F.col("containment") >= least) & F.col("position").isNotNull())
    )
