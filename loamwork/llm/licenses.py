"""Operator 4: licence notices in paragraphs, by a classifier over word n-grams. DataFrame functions only.

A paragraph is looked at line by line, and from each line with a telling n-gram on together with the next two (up to a
blank line), as notices may be wrapped. Features are the words and word pairs (ASCII, lower case) that occur in any
template. A softmax regression over licence families and an unknown class is trained by gradient passes that are DataFrame aggregations; only
gradients (one number for each family and template n-gram, a bounded vocabulary) come to the driver. Positive examples
are the templates, alone and inside other text; unknown ones are a bounded sample of the corpus's own paragraphs.

The probability from which a family is believed is calibrated on paragraphs held out of training, of the unknown class and
of templates in a frame that training hasn't seen. A prediction counts only if most of the n-grams of one of the family's
templates are there; a further family counts beside it if one of its templates is there in full.

Scoring skips, exactly, what can't win: from the weights follows a set of strong n-grams without one of which no family
can reach the unknown class.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_and_text, materialize

UNKNOWN = "unknown"
#: Usual wordings of public licence notices, by family.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Use of this source code is governed by a BSD-style license."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "Released into the public domain under CC0 1.0 Universal."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without written permission."),
]
#: What stands around a notice in the training examples.
_AROUND = [("", ""), ("Copyright (c) 2020 the authors. ", ""), ("", " See the file for details."), ("Text and images here. ", " More of the text follows in the next part.")]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def ngrams_of(text: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    words = words_of(text)
    pairs = F.zip_with(words, F.slice(words, 2, 1_000_000_000), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.contains(" "))))


def _inline(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A small table from values on the driver."""
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


@dataclass
class LicenceModel:
    families: list[str]  # the unknown class last
    weights: dict[str, list[float]]  # n-gram -> a weight for each class; "" is the bias
    threshold: float
    strong: list[str]
    recall: float  # of held-out notices, at the threshold
    false_alarms: float  # of held-out unknown paragraphs


def _paragraphs(docs: DataFrame) -> DataFrame:
    """(key, key2, para, line, second, third): each line that isn't blank, with the two after it."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    after = lambda n: F.slice(lines, n, 1_000_000_000)
    units = F.arrays_zip(lines.alias("line"), after(2).alias("second"), after(3).alias("third"))
    keyed = id_and_text(docs).select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text", F.lit(1), "doc_id").alias("key2"), F.posexplode(units).alias("para", "unit"))
    return keyed.select("key", "key2", "para", *[F.col("unit")[n].alias(n) for n in ("line", "second", "third")]).where(F.trim("line") != "")


def _logits(examples: DataFrame, weights: DataFrame, keys: list[str], n: int, bias: list[float]) -> DataFrame:
    """z: a value for each class, for rows with an array of n-grams ``grams``; every row has a bias of its own."""
    spread = examples.select(*keys, F.explode("grams").alias("g"))
    sums = spread.join(F.broadcast(weights), "g").groupBy(*keys).agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(n)])
    return sums.select(*keys, F.array(*[F.col(f"z{i}") + F.lit(bias[i]) for i in range(n)]).alias("z"))


def _softmax(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, x: s + x))


def train(docs: DataFrame, sample_paragraphs: int = 4000, passes: int = 14, rate: float = 0.8, decay: float = 1e-3) -> LicenceModel:
    """Fit on the templates and on ``sample_paragraphs`` lines of ``docs`` at most: those whose text has the least hashes."""
    spark = docs.sparkSession
    families = [*dict.fromkeys(f for f, _ in TEMPLATES), UNKNOWN]
    n = len(families)
    templates = _inline(spark, [{"family": f, "line": a + t + b, "frame": i} for f, t in TEMPLATES for i, (a, b) in enumerate(_AROUND)], "family string, line string, frame int")
    vocabulary = sorted(r[0] for r in _inline(spark, [{"line": t} for _, t in TEMPLATES], "line string").select(F.explode(ngrams_of(F.col("line")))).distinct().collect())
    known = F.array(*map(F.lit, vocabulary))
    label = F.element_at(F.from_json(F.lit(json.dumps({f: i for i, f in enumerate(families)})), "map<string,int>"), F.col("family"))
    lines = _paragraphs(docs).select("line")
    total = max(1, lines.count())
    share = max(1, int(2_000_000 * sample_paragraphs / total))
    luck = F.pmod(F.xxhash64("line"), F.lit(1_000_000))
    drawn = lines.where(luck < share).orderBy(luck, F.xxhash64("line", F.lit(1)), F.md5("line")).limit(sample_paragraphs)
    noticed = F.exists(F.array(*[F.lit(t.lower().rstrip(".")) for _, t in TEMPLATES]), lambda t: F.lower("line").contains(t))
    unknown = drawn.where(~noticed).select(F.lit(UNKNOWN).alias("family"), "line", F.lit(0).alias("frame"))
    made = templates.union(unknown).select(label.alias("y"), "frame", F.xxhash64("line").alias("id"), F.array_intersect(ngrams_of(F.col("line")), known).alias("grams"))
    held = F.when(F.col("y") == n - 1, F.pmod("id", F.lit(4)) == 0).otherwise(F.col("frame") == len(_AROUND) - 1)
    rows = materialize(made.dropDuplicates(["id"]).withColumn("held", held).coalesce(1), "licence-examples")
    fit = rows.where("not held").select("id", "y", F.concat("grams", F.array(F.lit(""))).alias("grams")).cache()
    size = max(1, fit.count())
    weights = {g: [0.0] * n for g in [*vocabulary, ""]}
    power = {g: [1e-8] * n for g in weights}
    for _ in range(passes):
        table = _inline(spark, [{"g": g, "w": w} for g, w in weights.items()], "g string, w array<double>")
        found = _logits(fit, table, ["id", "y"], n, [0.0] * n).select("id", "y", _softmax(F.col("z")).alias("p"))
        slope = fit.select("id", F.explode("grams").alias("g")).join(found, "id").groupBy("g").agg(*[F.sum(F.col("p")[i] - (F.col("y") == i).cast("double")).alias(f"d{i}") for i in range(n)])
        for r in slope.collect():
            w, s = weights[r["g"]], power[r["g"]]
            for i in range(n):
                d = r[f"d{i}"] / math.sqrt(size) + decay * w[i]
                s[i] += d * d
                w[i] -= rate * d / math.sqrt(s[i])
    fit.unpersist()
    table = _inline(spark, [{"g": g, "w": w} for g, w in weights.items() if g], "g string, w array<double>")
    tried = _logits(rows.where("held"), table, ["id", "y"], n, weights[""]).select("y", _softmax(F.col("z")).alias("p"))
    tried = tried.select((F.col("y") < n - 1).alias("notice"), F.when(F.col("y") < n - 1, F.get("p", F.col("y"))).otherwise(F.array_max(F.slice("p", 1, n - 1))).alias("p"))
    unknown_high, notice_low = (tried.agg(F.percentile(F.when(F.col("notice") == c, F.col("p")), F.lit(q))).first()[0] for c, q in ((False, 0.999), (True, 0.01)))
    # between what unknown paragraphs reach and what notices keep, or, where they overlap, above the former
    level = notice_low / 2 if unknown_high is None else max(unknown_high, (unknown_high + notice_low) / 2)
    rates = tried.groupBy("notice").agg(F.avg((F.col("p") >= level).cast("double")).alias("r")).collect()
    rate = {r["notice"]: r["r"] for r in rates}
    return LicenceModel(families, weights, level, _strong(weights, n), rate.get(True, 0.0), rate.get(False, 0.0))


def _strong(weights: dict[str, list[float]], n: int) -> list[str]:
    """n-grams of which a paragraph needs one at least for any family to reach the unknown class."""
    bias = max(b - weights[""][-1] for b in weights[""][:-1])
    gains = sorted((max(0.0, max(w[i] - w[-1] for i in range(n - 1))), g) for g, w in weights.items() if g)
    total, strong = bias, []
    for gain, g in gains:
        total += gain
        if total >= 0:
            strong.append(g)
    return strong


def licence_scan(docs: DataFrame, model: LicenceModel, confirm: float = 0.75) -> DataFrame:
    """doc_id, n_paragraphs, n_notices, licences (sorted, comma-joined), probability (highest), for every row of ``docs``.

    Null and empty texts have no paragraphs. ``confirm``: the share of a template's n-grams that must be present.
    A notice is a line that holds one, or a run of lines that do only together. Repeated rows have equal results. An empty
    table gives no rows.
    """
    spark, n = docs.sparkSession, len(model.families)
    vocabulary = sorted(g for g in model.weights if g)
    known, strong = F.array(*map(F.lit, vocabulary)), F.array(*map(F.lit, model.strong))
    keys = ["key", "key2", "para", "wrapped"]
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    joined = F.when(full(F.col("second")), F.concat_ws(" ", "line", "second", F.when(full(F.col("third")), F.col("third"))))
    lines = _paragraphs(docs).select("key", "key2", "para", joined.alias("joined"), F.array_intersect(ngrams_of(F.col("line")), known).alias("grams"))
    near = lines.where(F.arrays_overlap("grams", strong) if model.strong else F.lit(False)).dropDuplicates(keys[:3])
    alone = F.struct(F.lit(False).alias("wrapped"), F.col("grams"))
    together = F.when(F.col("joined").isNotNull(), F.struct(F.lit(True).alias("wrapped"), F.array_intersect(ngrams_of(F.col("joined")), known).alias("grams")))
    near = materialize(near.select("key", "key2", "para", F.inline(F.array_compact(F.array(alone, together)))), "licence-paragraphs")
    table = _inline(spark, [{"g": g, "w": w} for g, w in model.weights.items() if g], "g string, w array<double>")
    scored = _logits(near, table, keys, n, model.weights[""]).select(*keys, _softmax(F.col("z")).alias("p"))
    best = scored.select(*keys, F.slice("p", 1, n - 1).alias("p"), (1 - F.get("p", F.lit(n - 1))).alias("known"))
    best = best.select(*keys, "known", F.array_max("p").alias("probability"), F.array_position("p", F.array_max("p")).cast("int").alias("i"))
    names = F.array(*map(F.lit, model.families))
    sure = best.where(F.col("known") >= model.threshold).select(*keys, "probability", F.element_at(names, F.col("i")).alias("best"))
    wanted = _inline(spark, [{"family": f, "line": t} for f, t in TEMPLATES], "family string, line string").select("family", ngrams_of(F.col("line")).alias("template"))
    there = F.size(F.array_intersect("template", "grams")) / F.size("template")
    first = (F.col("family") == F.col("best")) & (F.col("probability") >= model.threshold) & (there >= confirm)
    # what passed the classifier is held against the fixed list of templates
    listed = F.from_json(F.lit(json.dumps([r.asDict() for r in wanted.collect()])), "array<struct<family string, template array<string>>>")
    compared = sure.join(near, keys).select("*", F.inline(listed))
    confirmed = compared.where(first | (there == 1)).select(*keys, "family", "probability").distinct()
    lines_of = lambda wrapped: F.collect_set(F.when(F.col("wrapped") == wrapped, F.col("para")))
    found = confirmed.groupBy("key", "key2").agg(lines_of(False).alias("single"), lines_of(True).alias("wrapped"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licences"), F.max("probability").alias("probability"))
    runs = F.filter("wrapped", lambda p: ~F.arrays_overlap("single", F.array(p, p + 1, p + 2)) & ~F.array_contains("wrapped", p - 1))
    by_row = found.select("key", "key2", (F.size("single") + F.size(runs)).cast("long").alias("n_notices"), "licences", "probability")
    text = F.coalesce("text", F.lit(""))
    rows = id_and_text(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text", F.lit(1), "doc_id").alias("key2"), F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n_paragraphs"))
    out = rows.join(by_row, ["key", "key2"], "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
