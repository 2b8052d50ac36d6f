"""License scans by a trained paragraph classifier, in DataFrame functions and Spark ML only.

A sparse logistic regression over word n-grams (one and two words) tells licence families from "unknown". It is trained on
published notices, varied by rule, and on paragraphs of at most ``SAMPLE_DOCS`` documents of the corpus. Its probabilities are
made honest by a temperature fitted on paragraphs it has not seen; below ``THRESHOLD`` a paragraph stays unknown. A predicted
family counts as confirmed if the paragraph holds enough of the words of one of the family's notices.

Scoring covers every paragraph: n-gram hashes meet the table of non-zero weights (at most ``VOCABULARY`` rows, broadcast), and
only paragraphs with such n-grams go on; all others have the constant score of a paragraph without evidence.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut

SAMPLE_DOCS = 400  # documents whose paragraphs serve as "unknown" (at most SAMPLE_PARAGRAPHS of them)
SAMPLE_PARAGRAPHS = 6_000
VOCABULARY = 20_000
THRESHOLD = 0.5
CONTAINED = 0.6  # share of a notice's words that a confirmed paragraph holds
UNKNOWN = "unknown"

# Short notices by which texts declare their licence.
NOTICES = {
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL-3.0.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under CC0 1.0 Universal public domain dedication.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL-3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL-2.1.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
}
FAMILIES = (*NOTICES, UNKNOWN)


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def grams(own: Column) -> Column:
    """64-bit hashes of the distinct words and pairs of neighbouring words."""
    pairs = F.zip_with(
        F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 2, F.size(own)),
        lambda a, b: F.xxhash64(a, b),
    )
    return F.array_distinct(F.concat(F.transform(own, lambda x: F.xxhash64(x)), pairs))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _row, _copy, par, text): the lines of a text that hold more than spaces, numbered from 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_row"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_copy", F.monotonically_increasing_id())
    lines = rows.select("id", "_row", "_copy", F.posexplode(F.split("_text", "\n", -1)).alias("par", "text"))
    return lines.filter(F.trim("text") != "")


def _notices(spark: SparkSession) -> DataFrame:
    """(family, notice): a fixed, small table."""
    rows = [(family, n) for family, own in NOTICES.items() for n in own]
    values = ", ".join("({}, {})".format(*("'" + x.replace("'", "\\'") + "'" for x in r)) for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(family, notice)")


def _held(notice_words: str, own: str) -> Column:
    """Share of a notice's words that a paragraph holds."""
    return F.size(F.array_intersect(notice_words, own)) / F.size(F.array_distinct(notice_words))


def training_set(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(family, own, part): words of varied notices and of corpus paragraphs that resemble none; part 4 is kept for calibration."""
    spark = docs.sparkSession
    notices = _notices(spark).withColumn("w", words(F.col("notice")))
    # Variations by rule: whole, without one word, with words of other texts before or after.
    n = F.size("w")
    whole = notices.select("family", "w", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    lacking = notices.select("family", "w", F.posexplode("w").alias("i", "gone")).filter(n > 5)
    lacking = lacking.select("family", F.concat(F.slice("w", 1, F.col("i")), F.slice("w", F.col("i") + 2, n)).alias("own"), "i")
    filler = (
        F.array(*[F.lit(x) for x in "project c 2024 see file".split()]),
        F.array(*[F.lit(x) for x in "all code in this repository".split()]),
        F.array(*[F.lit(x) for x in "unless noted otherwise contents are".split()]),
    )
    wrapped = None
    for i, f in enumerate(filler):
        both = notices.select("family", F.concat(f, "w").alias("own"), F.lit(i).alias("i")).unionByName(
            notices.select("family", F.concat(F.col("w"), f).alias("own"), F.lit(i + 1).alias("i"))
        )
        wrapped = both if wrapped is None else wrapped.unionByName(both)
    known = whole.select("family", F.col("w").alias("own"), "i").unionByName(lacking).unionByName(wrapped)
    known = known.select("family", "own", (F.col("i") % 5).alias("part"))

    ids = docs.select(F.col(id_col).alias("_id")).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_DOCS)
    some = docs.join(F.broadcast(ids), F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")  # at most SAMPLE_DOCS ids
    texts = paragraphs(some, id_col, text_col).select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(SAMPLE_PARAGRAPHS)
    texts = texts.select("text", words(F.col("text")).alias("own"))
    like = texts.join(F.broadcast(notices), _held("w", "own") >= 0.5, "left_anti")  # against the fixed notices
    unknown = like.filter(F.size("own") > 0).select(
        F.lit(UNKNOWN).alias("family"), "own", F.pmod(F.xxhash64("text"), F.lit(5)).cast("int").alias("part")
    )
    return cut(known.unionByName(unknown).coalesce(1))  # a bounded sample: one file, one task for each round of the fit


@dataclass(frozen=True)
class Model:
    """Non-zero weights (h, w: one per family) as a table, intercepts, and the temperature."""

    weights: DataFrame
    intercepts: tuple[float, ...]
    temperature: float


def train(docs: DataFrame, id_col: str, text_col: str) -> Model:
    """Fit the classifier; works on an empty corpus too, then against an empty paragraph alone."""
    spark = docs.sparkSession
    data = training_set(docs, id_col, text_col)
    empty = spark.sql(f"SELECT '{UNKNOWN}' AS family, array('', '') AS own, explode(array(0, 4)) AS part")
    data = data.unionByName(empty.select("family", F.col("own").cast("array<string>").alias("own"), "part"))
    index = F.array_position(F.array(*[F.lit(x) for x in FAMILIES]), F.col("family")) - 1
    keyed = data.select(
        F.transform(grams(F.col("own")), lambda x: x.cast("string")).alias("grams"), index.cast("double").alias("label"), "part"
    )
    share = F.when(F.col("label") == FAMILIES.index(UNKNOWN), 1.0).otherwise(8.0)
    fitted, unseen = keyed.filter("part <> 4").withColumn("weight", share), keyed.filter("part = 4")
    vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=VOCABULARY, minDF=2).fit(fitted)
    regression = LogisticRegression(
        family="multinomial", regParam=3e-4, elasticNetParam=1.0, maxIter=60, standardization=False, weightCol="weight"
    ).fit(vectors.transform(fitted))
    matrix, intercepts = regression.coefficientMatrix.toArray(), regression.interceptVector.toArray()
    have = matrix.shape[0]
    rows = [
        (int(h), [float(x) for x in matrix[:, k]] + [0.0] * (len(FAMILIES) - have))
        for k, h in enumerate(vectors.vocabulary) if matrix[:, k].any()
    ]
    text = json.dumps([{"h": h, "w": w} for h, w in rows])
    table = F.inline(F.from_json(F.lit(text), "array<struct<h: bigint, w: array<double>>>"))
    weights = spark.range(1).select(table)  # at most VOCABULARY rows
    raw = regression.transform(vectors.transform(unseen)).select(vector_to_array("rawPrediction").alias("raw"), "label")
    temperature = _temperature([(r["raw"], int(r["label"])) for r in raw.collect()])  # a bounded sample
    return Model(cut(weights), tuple(float(x) for x in intercepts), temperature)


def _temperature(rows: list[tuple[list[float], int]]) -> float:
    """The divisor of the logits that makes the held-out paragraphs likeliest."""

    def loss(t: float) -> float:
        total = 0.0
        for raw, label in rows:
            top = max(raw)
            total += math.log(sum(math.exp((x - top) / t) for x in raw)) - (raw[label] - top) / t
        return total

    return min((0.5 + 0.1 * i for i in range(36)), key=loss) if rows else 1.0


def scan(docs: DataFrame, id_col: str, text_col: str, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(id, _row, par, family, probability, confirmed, text): paragraphs of a known family.

    ``family`` is the likeliest one if its calibrated probability reaches ``threshold`` (paragraphs below are unknown and left
    out); ``confirmed`` tells whether one of its notices agrees. Null, empty and blank texts have no paragraphs; rows that
    repeat id and text give the same paragraphs once; an empty table gives no rows.
    """
    weights = F.broadcast(model.weights)  # at most VOCABULARY rows
    pars = paragraphs(docs, id_col, text_col)
    # Copies of a row are summed apart.
    spread = pars.select("id", "_row", "par", "_copy", F.explode(grams(words(F.col("text")))).alias("h"))
    hit = spread.join(weights, "h")
    sums = [F.sum(F.col("w")[i]) for i in range(len(FAMILIES))]
    scored = hit.groupBy("id", "_row", "par", "_copy").agg(
        F.array(*[s + c for s, c in zip(sums, model.intercepts, strict=True)]).alias("z")
    )
    top = F.array_max("z")
    total = F.aggregate(
        F.transform("z", lambda x: F.exp((x - top) / model.temperature)), F.lit(0.0), lambda a, x: a + x
    )
    names = F.array(*[F.lit(x) for x in FAMILIES])
    found = scored.select(
        "id", "_row", "par", F.element_at(names, F.array_position("z", top).cast("int")).alias("family"),
        (1 / total).alias("probability"),
    ).filter((F.col("family") != UNKNOWN) & (F.col("probability") >= threshold))
    found = cut(found.distinct())
    # Texts of the predicted paragraphs, and the best of the family's notices.
    same = pars["id"].eqNullSafe(found["id"]) & (pars["_row"] == found["_row"]) & (pars["par"] == found["par"])
    texts = pars.join(found, same).select(
        found["id"], found["_row"], found["par"], "family", "probability", "text", words(F.col("text")).alias("own")
    ).dropDuplicates(["id", "_row", "par"])
    notices = _notices(docs.sparkSession).groupBy("family").agg(F.collect_list(words(F.col("notice"))).alias("notices"))
    best = F.array_max(F.transform("notices", lambda w: F.size(F.array_intersect(w, F.col("own"))) / F.size(F.array_distinct(w))))
    checked = texts.join(F.broadcast(notices), "family")
    return checked.select("id", "_row", "par", "family", "probability", (best >= CONTAINED).alias("confirmed"), "text")


def by_document(docs: DataFrame, id_col: str, text_col: str, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_paragraphs, n_predicted, n_confirmed, families): every row of ``docs``; families are the confirmed ones, sorted."""
    found = scan(docs, id_col, text_col, model, threshold)
    sums = cut(
        found.groupBy("id", "_row").agg(
            F.count(F.lit(1)).alias("n_predicted"), F.sum(F.col("confirmed").cast("int")).alias("n_confirmed"),
            F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
        )
    )
    n = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: F.trim(x) != ""))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_row"), n.cast("bigint").alias("n_paragraphs"))
    joined = own.join(sums, own["id"].eqNullSafe(sums["id"]) & (own["_row"] == sums["_row"]), "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        own["id"], "n_paragraphs", F.coalesce("n_predicted", zero).alias("n_predicted"),
        F.coalesce("n_confirmed", zero).alias("n_confirmed"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
    )
