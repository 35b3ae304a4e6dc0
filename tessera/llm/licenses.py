"""Licence scan: a trained paragraph classifier confirmed by templates, with DataFrame operations only.

A paragraph is a line of the text. A sparse logistic regression on word n-grams tells licence families from other
paragraphs (the unknown class), which it learns from ordinary lines, from lines that share words with a notice without being
one, and from licence-like sentences. How sure it is that a paragraph is a notice is calibrated on examples that it did not
learn from. Of the families it finds likeliest, the one whose template agrees best is confirmed, if it agrees enough.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch

UNKNOWN = "unknown"
#: Short notices of licence families, as their publishers word them.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "This project is licensed under the Simplified BSD License."),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}
#: Identifiers in the tags of files ("SPDX-License-Identifier: .."), by family.
TAGS = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3.0", "GPL-2.0": "GPL-2.0", "AGPL-3.0": "AGPL-3.0", "LGPL-3.0": "LGPL-3.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC", "Unlicense": "Unlicense", "MPL-2.0": "MPL-2.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0"}
#: Sentences that use the words of notices without being one: members of the unknown class.
UNKNOWNS = (
    "You need a driving license to use this vehicle in the city.",
    "The restaurant lost its liquor license and closed.",
    "Permission to enter the building was granted by the owner, free of charge.",
    "The work of the foundation is published every year.",
    "This work is subject to change without notice.",
    "Copies of the documentation files are kept in the archive.",
    "The general public may use the library on Sundays.",
    "He released the software under pressure from the public.",
    "The terms of the agreement are met by both parties.",
    "Attribution of the painting to the master is disputed by an international committee.",
    "The project is licensed to operate in three states.",
    "The source code form has to be signed and returned.",
    "All rights reserved by the publisher of this book.",
    "Licenses for fishing are sold at the town hall, version and price as stated.",
    "Modify the recipe as you like and share it with friends.",
    "The commons were open to creative people from all countries.",
)
#: Words that alone don't make a pair of words typical of a notice.
STOP = ("a", "and", "any", "are", "as", "by", "for", "in", "is", "it", "may", "not", "of", "or", "that", "the", "this", "to", "use", "with", "you")
#: Most documents whose lines are examples of the unknown class; most terms of the model; least calibrated probability;
#: least agreement with a template, and the largest of a line that is an example of the unknown class; families compared.
TRAIN_DOCS, TERMS, SURE, AGREE, APART, LIKELY = 400, 1 << 14, 0.5, 0.7, 0.4, 3


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\p{N})"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Neighbouring words, of which one at least is no stop word."""
    both = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull() & ~(a.isin(*STOP) & b.isin(*STOP)), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.array_compact(both))


def _grams(words: Column) -> Column:
    three = F.transform(words, lambda w, i: F.when(i + 2 < F.size(words), F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))))
    two = F.transform(words, lambda w, i: F.when(i + 1 < F.size(words), F.concat_ws(" ", w, F.get(words, i + 1))))
    return F.array_distinct(F.array_compact(F.concat(words, two, three)))


def _every_but(words: Column, k: int) -> Column:
    return F.filter(words, lambda w, i: i % 7 != k)


def _paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph from 0, words) of every line with words."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    return lines.select("doc_id", "paragraph", _words(F.col("line")).alias("words")).where(F.size("words") > 0)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row (doc_id, paragraph, family, probability, agreement) for each paragraph that holds a notice of a known family.

    paragraph counts lines from 0; probability is the calibrated one that the line is a notice; agreement is the largest share of
    neighbouring words in common with a template of the family (of the shorter of the two). Paragraphs that share no
    typical pair of words with any template cannot agree with one, so they are not scored: they are unknown. Documents
    without a notice give no rows, nor do null and empty texts or empty tables; repeated rows each give theirs; a null
    doc_id is kept. Whole texts are read; other columns are not. The examples of the unknown class come
    from TRAIN_DOCS documents and from UNKNOWNS.
    """
    spark = docs.sparkSession
    texts = [(f, t) for f, own in TEMPLATES.items() for t in (*own, f"SPDX-License-Identifier: {TAGS[f]}")]
    given = spark.createDataFrame(texts, "family string, text string")
    templates = given.select("family", _words(F.col("text")).alias("words")).select("family", "words", _pairs(F.col("words")).alias("template"))
    typical = sorted(r[0] for r in templates.select(F.explode("template")).distinct().collect())  # as long as the templates above
    known = F.array(*[F.lit(x) for x in typical])

    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    sample = _paragraphs(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")).select("words", _pairs(F.col("words")).alias("pairs"))
    # a line that shares words with a template without agreeing with it is unknown too; one that nearly agrees is no example
    share = F.size(F.array_intersect("pairs", "template")) / F.greatest(F.lit(1), F.least(F.size("pairs"), F.size("template")))
    near = sample.where(F.arrays_overlap("pairs", known)).join(F.broadcast(templates.select("template")), F.arrays_overlap("pairs", "template")).groupBy("words").agg(F.max(share).alias("agreement"))
    unlike = sample.where(~F.arrays_overlap("pairs", known)).select("words")
    ordinary = unlike.unionByName(near.where(F.col("agreement") <= APART).select("words")).unionByName(spark.createDataFrame([(x,) for x in UNKNOWNS], "text string").select(_words(F.col("text")).alias("words")))
    # a notice may be cut off, worded a little otherwise, or stand among other words: these are examples of it as well
    w = F.col("words")
    half = F.greatest(F.lit(3), F.ceil(F.size(w) / 2).cast("int"))
    without = [_every_but(w, k) for k in (2, 3, 4)]
    among = unlike.where(F.size("words") >= 6).orderBy(F.xxhash64("words")).limit(1).select(F.slice("words", 1, 6).alias("other"))  # one row
    parts = templates.join(F.broadcast(among), F.lit(True), "left").select("family", F.explode(F.array_compact(F.array(w, F.slice(w, 1, half), F.slice(w, -F.least(half, F.size(w)), half), *without, F.concat("other", w), F.concat(w, "other")))).alias("words"))
    families = list(TEMPLATES)
    number = reduce(lambda c, k: c.when(F.col("family") == families[k], k + 1), range(1, len(families)), F.when(F.col("family") == families[0], 1))
    examples = parts.select(number.alias("label"), "words").unionByName(ordinary.select(F.lit(0).alias("label"), "words")).select(F.col("label").cast("double"), _grams(F.col("words")).alias("grams"), F.pmod(F.xxhash64("words"), F.lit(4)).alias("fold"))
    examples = examples.withColumn("weight", F.when(F.col("label") == 0, 1.0).otherwise(20.0)).repartition(2).persist()
    learned, kept = examples.where("fold <> 0"), examples.where("fold = 0")
    counts = CountVectorizer(inputCol="grams", outputCol="x", vocabSize=TERMS, binary=True).fit(learned)
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=0.002, elasticNetParam=0.5, maxIter=25, family="multinomial", standardization=False).fit(counts.transform(learned))
    sure = _calibrated(model.transform(counts.transform(kept)))
    examples.unpersist()
    matrix, base = model.coefficientMatrix.toArray(), model.interceptVector.toArray().tolist()
    base += [-1e9] * (len(families) + 1 - len(base))
    weights = [(t, [*matrix[:, k].tolist(), *[0.0] * (len(base) - len(matrix))]) for k, t in enumerate(counts.vocabulary) if matrix[:, k].any()]
    table = spark.createDataFrame(weights, "gram string, weights array<double>")

    # written, so that the few lines that go on keep their numbers and no text is split into words again
    maybe = scratch.cut(_paragraphs(docs).withColumn("pairs", _pairs(F.col("words"))).where(F.arrays_overlap("pairs", known)).withColumn("row", F.monotonically_increasing_id()))
    sums = [F.coalesce(F.sum(F.get("weights", F.lit(k))), F.lit(0.0)) + F.lit(base[k]) for k in range(len(base))]
    scored = maybe.select("row", F.explode(_grams(F.col("words"))).alias("gram")).join(F.broadcast(table), "gram", "left").groupBy("row").agg(F.array(*sums).alias("z"))
    names = F.array(*[F.lit(x) for x in families])
    ranked = F.slice(F.array_sort(F.transform(F.slice("z", 2, len(families)), lambda z, i: F.struct((-z).alias("low"), F.get(names, i).alias("family")))), 1, LIKELY)
    guess = scored.select("row", ranked.alias("likely"), (-F.get(ranked, F.lit(0))["low"] - F.get("z", F.lit(0))).alias("margin"))
    guess = guess.select("row", F.inline("likely"), sure(F.col("margin")).alias("probability")).where(F.col("probability") >= SURE)
    against = guess.join(maybe.select("row", "doc_id", "paragraph", "pairs"), "row").join(F.broadcast(templates.select("family", "template")), "family")
    best = against.groupBy("row").agg(F.max(F.struct(share.alias("agreement"), -F.col("low"), "family", "doc_id", "paragraph", "probability")).alias("b"))
    return best.where(F.col("b.agreement") >= AGREE).select("b.doc_id", "b.paragraph", "b.family", "b.probability", "b.agreement")


def _calibrated(scored: DataFrame) -> Callable[[Column], Column]:
    """The probability of a notice by the margin of the best family over the unknown class, from examples that were not learned from."""
    raw = vector_to_array("rawPrediction")
    top = F.array_max(F.slice(raw, 2, F.size(raw) - 1)) - F.get(raw, F.lit(0))
    rows = scored.select("label", top.alias("m"), "weight").where(F.col("m").isNotNull())
    rows = VectorAssembler(inputCols=["m"], outputCol="v").transform(rows.select((F.col("label") > 0).cast("double").alias("y"), "m", "weight"))
    if rows.select("y").distinct().count() < 2:
        return lambda m: 1 / (1 + F.exp(-m))
    fit = LogisticRegression(featuresCol="v", labelCol="y", weightCol="weight", regParam=0.01, maxIter=50).fit(rows)
    a, b = float(fit.coefficients[0]), float(fit.intercept)
    return lambda m: 1 / (1 + F.exp(-(F.lit(a) * m + F.lit(b))))
