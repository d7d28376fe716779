"""Finds licence notices in texts: MinHash bands over overlapping windows (DataFrame operations only).

A text is the row of its k-word shingle hashes. A hash function of the family is "exclusive or with a constant"; its minimum over a
set is the member nearest to the constant, and as shingle hashes are uniform, two sets agree in it with the
probability of their Jaccard similarity. Minima are taken of blocks of ``BLOCK`` shingles once, and windows
of 2, 4, 8, ... blocks, one starting at every block, get theirs from two windows half as long.

Templates are put into classes by their length in shingles. A match that has to hold all n distinct shingles (up to 4 at 80 percent)
is certain to be met by single shingles as windows and one band. For other templates the class has the shortest window
that holds their shingles wherever they start; a match then has Jaccard similarity J >= need / (window + n - need)
to some window, need = ceil(n * percent / 100), and with b bands of one row it is found with
probability 1 - (1 - J)^b. ``bands_for`` takes b so that this is at least 0.999.

A window can only agree with a template in a band if it holds the very shingle that is the template's minimum there. So
texts without any of these shingles are left out before minima are taken: they could not be retrieved.

Windows found are candidates only. Candidates are verified by exact containment: the shingles of the template,
as words, that are in the window and its surroundings.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.common import checkpointed

BLOCK = 4
SURE = 0.999

#: Widely used licence notices, as their stewards publish them.
TEMPLATES = (
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-4.0-line", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0-line", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("mit-line", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
)


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license_id string, text string")


def _need(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def window_blocks(n: int, percent: int, length: int | None = None) -> int:
    """Blocks in the window of templates of n distinct shingles, ``length`` in all; 0: single shingles, as a match holds each of the n."""
    return 0 if _need(n, percent) == n else 2 ** max(1, math.ceil(math.log2(((length or n) + BLOCK - 1) / BLOCK)))


def bands_for(n: int, percent: int, length: int | None = None) -> int:
    """Bands of one row with which a match is found with probability ``SURE`` or more."""
    blocks = window_blocks(n, percent, length)
    if blocks == 0:
        return 1
    share = _need(n, percent) / (blocks * BLOCK + n - _need(n, percent))
    return math.ceil(math.log(1 - SURE) / math.log(1 - share))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >= 1 << 63 else x


def _constant(j: int) -> int:
    """All 64 bits vary: minima are those of signed numbers."""
    return _signed((j + 1) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019)


def _literals(values) -> str:
    return ", ".join(f"{v}L" if v > -(1 << 63) else "CAST('-9223372036854775808' AS BIGINT)" for v in sorted(set(values)))


def _with_shingles(df: DataFrame, k: int) -> DataFrame:
    """``df`` with words and sh, the hashes of its k-word shingles.

    sh is made from the text with its words named by an outer transform: whatever the optimizer inlines, a text is split once.
    """
    words = "filter(split(translate(coalesce(CAST(text AS STRING), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    parts = ", ".join(f"get(ws, i + {j})" for j in range(k))
    shingles = f"element_at(transform(array({words}), ws -> if(size(ws) < {k}, array(), transform(sequence(0, size(ws) - {k}), i -> xxhash64({parts})))), 1)"
    return df.withColumn("words", F.expr(words)).withColumn("sh", F.expr(shingles))


def license_matches(docs: DataFrame, templates: DataFrame | None = None, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per text of ``docs(doc_id, text, ...)`` and template (``templates(license_id, text)``) that it holds.

    doc_id, license_id, n_template_shingles, n_shared, containment (shared / template shingles in the best window, at least
    percent / 100), n_windows (windows that reach it), first_word, last_word (the span of those windows in words, 0-based). A template
    of fewer than k words, or a null one, matches nothing, as does a text of fewer than k words.
    Of templates with one id each is matched. Null ids are carried as they are; rows equal in doc_id and text give one result.
    Long texts are searched whole. Where several windows hold equally many shingles, n_shared is the same for all, and the span covers them.
    Templates are a parameter of bounded number: their band values are collected and sent with the plan. Other columns are not read.
    """
    spark = docs.sparkSession
    templates = template_table(spark) if templates is None else templates
    own = _with_shingles(templates.select(F.col("license_id").cast("string").alias("license_id"), "text"), k).withColumn("sh", F.array_distinct("sh")).where("size(sh) > 0").collect()
    shape = "doc_id long, license_id string, n_template_shingles long, n_shared long, containment double, n_windows long, first_word long, last_word long"
    if not own:
        return spark.createDataFrame([], shape)
    classes: dict[int, int] = {}
    rows = []
    for number, r in enumerate(own):
        length = len(r["words"]) - k + 1
        n, distinct = len(r["sh"]), list(dict.fromkeys("\x01".join(r["words"][i : i + k]) for i in range(length)))
        m = window_blocks(n, percent, length)
        classes[m] = max(classes.get(m, 0), bands_for(n, percent, length))
        rows.append((number, r["license_id"], n, m, length, distinct, r["sh"]))
    bands: dict[tuple[int, int], dict[int, list[int]]] = {}
    for number, _, _, m, _, _, sh in rows:
        for j in range(classes[m]):
            value = min(_signed(h ^ _constant(j)) for h in sh)
            bands.setdefault((m, j), {}).setdefault(value, []).append(number)

    # One projection for each width of windows: rows are copied between projections, so there are few of them.
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The row number also keeps the filter from being pushed down, where it would compute the shingles again.
    telling = _literals(_signed(v ^ _constant(j)) for (_, j), vs in bands.items() for v in vs)
    some = _with_shingles(text, k).select("doc_id", "text", "sh", F.monotonically_increasing_id().alias("place")).where(F.expr(f"exists(sh, h -> h IN ({telling}))"))
    frame = some.select("doc_id", "text", "sh", F.expr(f"transform(sequence(0, CAST((size(sh) - 1) / {BLOCK} AS INT)), b -> slice(sh, b * {BLOCK} + 1, {BLOCK}))").alias("blocks"))
    hits, none = ["doc_id", "text", "hits"], "CAST(array() AS array<struct<m:int,j:int,at:int,v:bigint>>)"
    single = none
    if 0 in classes:
        values = _literals(_signed(v ^ _constant(0)) for v in bands[(0, 0)])
        single = f"transform(filter(sequence(0, size(sh) - 1), i -> element_at(sh, i + 1) IN ({values})), i -> named_struct('m', 0, 'j', 0, 'at', i, 'v', element_at(sh, i + 1) ^ {_literals([_constant(0)])}))"
    most, widest = max([b for m, b in classes.items() if m], default=0), max(classes)
    frame = frame.select("doc_id", "text", F.expr(single).alias("hits"), *[F.expr(f"transform(blocks, b -> array_min(transform(b, h -> h ^ {_literals([_constant(j)])})))").alias(f"x{j}") for j in range(most)])
    size = 1
    while size < widest:
        here = [j for j in range(most) if j < max(b for m, b in classes.items() if m > size)]
        frame = frame.select(*hits, *[F.expr(f"transform(x{j}, (v, i) -> least(v, get(x{j}, i + {size})))").alias(f"x{j}") for j in here])
        size *= 2
        if size in classes:
            new = []
            for j in range(classes[size]):
                values = _literals(bands[(size, j)])
                new.append(f"transform(filter(sequence(0, size(x{j}) - 1), i -> element_at(x{j}, i + 1) IN ({values})), i -> named_struct('m', {size}, 'j', {j}, 'at', i * {BLOCK}, 'v', element_at(x{j}, i + 1)))")
            frame = frame.select("doc_id", "text", F.expr(f"concat(hits, {', '.join(new)})").alias("hits"), *[f"x{j}" for j in here])
    numbered = frame.select("doc_id", "text", "hits", F.monotonically_increasing_id().alias("row")).where("size(hits) > 0")
    found = checkpointed(_with_shingles(numbered.dropDuplicates(["doc_id", "text"]), k).select("row", "doc_id", "words", "hits"))

    known = spark.createDataFrame([(m, j, v, number) for (m, j), vs in bands.items() for v, numbers in vs.items() for number in numbers], "m int, j int, v long, number int")
    full = spark.createDataFrame([row[:6] for row in rows], "number int, license_id string, n int, m int, length int, want array<string>")
    places = found.select("row", F.explode("hits").alias("x")).select("row", "x.*").join(F.broadcast(known), ["m", "j", "v"]).select("row", "number", "at").distinct()
    near = places.join(F.broadcast(full), "number").join(found.select("row", "doc_id", "words"), "row")
    start = F.greatest(F.lit(0), F.col("at") - F.when(F.col("m") == 0, F.col("length") - 1).otherwise(0))
    length = F.when(F.col("m") == 0, 2 * F.col("length") - 1).otherwise(F.col("m") * BLOCK)
    near = near.withColumn("start", start).withColumn("end", F.least(F.size("words") - k, start + length - 1))
    joined = ", ".join(f"element_at(words, i + {j + 1})" for j in range(k))
    seen = near.withColumn("have", F.expr(f"array_distinct(transform(sequence(start, end), i -> concat_ws('\x01', {joined})))")).withColumn("common", F.size(F.array_intersect("have", "want")))
    good = seen.where(F.col("common") * 100 >= F.col("n") * percent)
    return good.groupBy("row", "doc_id", "number", "license_id", "n").agg(
        F.max("common").alias("common"), F.count("*").alias("n_windows"), F.min("start").alias("first_word"), F.max(F.col("end") + k - 1).alias("last_word")
    ).select("doc_id", "license_id", F.col("n").cast("long").alias("n_template_shingles"), F.col("common").cast("long").alias("n_shared"), (F.col("common") / F.col("n")).alias("containment"), F.col("n_windows").cast("long").alias("n_windows"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"))
