"""Licence scans: a trained paragraph classifier over word n-grams, with an unknown class, confirmed against templates.

Paragraphs are single lines, and the lines up to a blank one joined, since notices are often wrapped. Those with a hint word
are candidates; every template has one. A multinomial logistic regression with
a sparsity penalty learns from stretches of the templates and from other paragraphs: candidates of the corpus that resemble
no template, and everyday uses of the same words. Its held-out predictions set the probability from which a family is
believed; anything below is unknown. A prediction counts only if the paragraph also contains enough of a template of that
family. Everything runs as DataFrame operations and Spark ML stages; only the bounded training set is collected by its solver.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import let, written

# The notices by which well-known licences are given.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "agpl-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "bsd": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD license."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0-1.0": ("Released under CC0 1.0, public domain dedication.", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    "reserved": ("Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without permission."),
}
OTHER = (
    "You need a driver license to rent a car here.", "The fishing license has to be renewed each year at the town hall.", "He lost his licence after the second offence.",
    "The copyright office is closed on public holidays.", "She asked for permission to leave early.", "The warranty covers parts and labour for two years.",
    "A poetic licence is taken with the dates in this story.", "The bar has been licensed to sell beer since May.", "The source of the river is in the public domain forest.",
    "Terms of the contract are listed under section 3 of the agreement.", "Version 2.0 of the program was released under the old name.", "All conditions are met and the work is free.",
)
UNKNOWN = "unknown"
HINTS = r"(?i)licen[cs]e|copyright|permission|redistribut|all rights reserved|creative commons|general public|public domain|copyleft|spdx"
#: The hints where a line may end between their words.
WRAPPED = HINTS.replace(" ", r"\W{1,9}")
FEATURES = 1 << 13
#: The documented bound on corpus paragraphs in the training set, as the unknown class.
TRAIN_ROWS = 2000
CONTAINED = 0.6
MIN_PROBABILITY = 0.5


def ngrams(text: Column) -> Column:
    """The distinct words and word pairs of a paragraph, in small letters; signs that join words into names stay."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"), F.lit(0))
    return let(words, lambda w: F.array_distinct(F.concat(w, F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, w[i + 1])))))


def templates(spark: SparkSession) -> DataFrame:
    """family, template, grams; a few dozen rows fixed above."""
    rows = [(family, t) for family, texts in TEMPLATES.items() for t in texts]
    return spark.createDataFrame(rows, "family string, template string").withColumn("grams", ngrams(F.col("template")))


def candidates(docs: DataFrame) -> DataFrame:
    """row, line (from 0), lines and text of every paragraph with a hint, from whole texts: single lines, and several lines up
    to one without letters and digits (blank, or a bare comment sign), joined. ``line`` is the first one, ``lines`` their number."""
    split = docs.where(F.col("text").rlike(WRAPPED)).select("row", F.split(F.translate("text", "\x01", " "), "\n", -1).alias("split"))
    single = split.select("row", F.posexplode("split").alias("line", "paragraph")).select("row", "line", F.lit(1).alias("lines"), "paragraph").where(F.col("paragraph").rlike(HINTS))
    # each line is led by its number and a sign that no text has now; a blank one is that alone, and parts the blocks
    led = F.transform("split", lambda x, i: F.concat(F.lit("\n"), i.cast("string"), F.lit("\x01"), F.when(x.rlike(r"[\p{L}\p{N}]"), x).otherwise("")))
    blocks = split.select("row", F.explode(F.split(F.array_join(led, ""), r"\n[0-9]++\x01(?=\n|$)", -1)).alias("block"))
    joined = blocks.select("row", F.regexp_extract("block", r"^\n([0-9]++)\x01", 1).try_cast("int").alias("line"), F.regexp_count("block", F.lit("\x01")).alias("lines"), F.regexp_replace("block", r"\n[0-9]++\x01", " ").alias("paragraph"))
    return single.unionByName(joined.where((F.col("lines") > 1) & F.col("paragraph").rlike(WRAPPED))).withColumn("grams", ngrams(F.col("paragraph")))


def containment(grams: Column, of: Column) -> Column:
    """The part of a template's n-grams that a paragraph has."""
    return F.size(F.array_intersect(grams, of)) / F.greatest(F.size(of), F.lit(1))


def resemblance(cands: DataFrame) -> DataFrame:
    """Adds ``likeness``: by family, the largest part of one of its templates that the paragraph contains. The templates are
    a fixed list, so they stand in the expression and nothing is joined."""
    known = templates(cands.sparkSession).collect()
    by_family: dict[str, list] = {}
    for r in known:
        by_family.setdefault(r.family, []).append(F.array(*map(F.lit, r.grams)))
    return cands.withColumn("likeness", F.create_map(*(x for f, ts in by_family.items() for x in (F.lit(f), F.greatest(*(containment(F.col("grams"), t) for t in ts), F.lit(0.0))))))


def training_set(cands: DataFrame, rows: int) -> DataFrame:
    """label, grams, held: stretches of every template (whole, without some words at either end, and between other words),
    everyday sentences, and the corpus's candidates of texts in which none resembles a template, at most ``rows`` by a hash."""
    spark = cands.sparkSession
    t = templates(spark).select("family", F.split("template", " ").alias("w"))
    cuts = t.select("family", "w", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("a")).select("family", "w", "a", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("b"))
    parts = cuts.where("size(w) - a - b >= greatest(3, 0.7 * size(w))").select("family", F.array_join(F.expr("slice(w, a + 1, size(w) - a - b)"), " ").alias("text"))
    fillers = F.explode(F.array(F.lit(""), F.lit("and the text goes on here"), F.lit("see the file for details"), F.lit("note that")))
    good = parts.select(F.col("family").alias("label"), "text", fillers.alias("filler")).select("label", ngrams(F.concat_ws(" ", "filler", "text")).alias("grams"))
    other = spark.createDataFrame([(s,) for s in OTHER], "text string").select(F.lit(UNKNOWN).alias("label"), "text", fillers.alias("filler")).select("label", ngrams(F.concat_ws(" ", "text", "filler")).alias("grams"))
    alike = cands.where(F.array_max(F.map_values("likeness")) >= 0.4).select("row").distinct()
    far = cands.join(alike.hint("merge"), "row", "left_anti").select(F.lit(UNKNOWN).alias("label"), "grams", F.xxhash64("grams").alias("h")).distinct().orderBy("h").limit(rows).select("label", "grams")
    return good.unionByName(other).unionByName(far).withColumn("held", F.pmod(F.xxhash64("grams", F.lit(9)), F.lit(4)) == 0)


def learn(train: DataFrame) -> tuple[LogisticRegressionModel, list[str], float]:
    """The model, its label names, and the probability from which a family is believed: just above the largest that any
    held-out paragraph of the unknown class reached, MIN_PROBABILITY at least and 0.9 at most."""
    names = sorted([*TEMPLATES, UNKNOWN])
    label = F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1
    data = written(HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(train.withColumn("y", label.cast("double"))).select("y", "features", "held", "label"), "licence-train")
    model = LogisticRegression(labelCol="y", family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60).fit(data.where("not held"))
    unknown = names.index(UNKNOWN)
    held = model.transform(data.where(F.col("held") & (F.col("label") == UNKNOWN))).select(vector_to_array("probability").alias("p"))
    worst = held.agg(F.max(1 - F.col("p")[unknown])).first()[0]
    return model, names, min(0.9, max(MIN_PROBABILITY, (worst or 0.0) + 0.01))


def scan(docs: DataFrame, rows: int = TRAIN_ROWS, contained: float = CONTAINED) -> DataFrame:
    """row, doc_id, found: array of (line, family, probability, likeness) of the paragraphs whose predicted family is
    believed and confirmed, by first line; several lines count where none of them alone gives the family. Null text has no paragraphs; rows that repeat are found alike; an empty table gives no
    rows. Only doc_id and text are used."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cands = written(resemblance(candidates(base)), "licence-candidates")
    model, names, level = learn(training_set(cands, rows))
    p = F.col("p")
    scored = model.transform(HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(cands)).withColumn("p", vector_to_array("probability"))
    best = scored.withColumn("probability", F.array_max(p)).withColumn("family", F.element_at(F.array(*map(F.lit, names)), F.array_position(p, F.col("probability")).cast("int")))
    sure = best.where((F.col("family") != UNKNOWN) & (F.col("probability") >= level)).withColumn("alike", F.col("likeness")[F.col("family")]).where(F.col("alike") >= contained)
    found = sure.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("line", "family", "probability", F.col("alike").alias("likeness"), "lines"))).alias("all"))
    alone = lambda x: F.exists("all", lambda y: (y["lines"] == 1) & (y["family"] == x["family"]) & y["line"].between(x["line"], x["line"] + x["lines"] - 1))
    found = found.select("row", F.transform(F.filter("all", lambda x: (x["lines"] == 1) | ~alone(x)), lambda x: F.struct(*(x[c].alias(c) for c in ("line", "family", "probability", "likeness")))).alias("found"))
    seen = cands.groupBy("row").agg(F.count("*").alias("n_candidates"))
    out = base.select("row", "doc_id").join(seen.hint("merge"), "row", "left").join(found.hint("merge"), "row", "left")
    none = F.expr("cast(array() as array<struct<line:int,family:string,probability:double,likeness:double>>)")
    return out.select("row", "doc_id", F.coalesce("n_candidates", F.lit(0).cast("long")).alias("n_candidates"), F.coalesce("found", none).alias("found"))
