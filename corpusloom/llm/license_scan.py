"""Licence scan: a trained paragraph classifier, in DataFrame functions on the data's path.

A sparse logistic regression over words and word pairs of the notices below tells licence families from unknown text.  It is
trained on the driver from noisy copies of the notices, on misleading sentences and on a bounded sample of the corpus's own
paragraphs; a temperature is then fitted on copies held out, so that probabilities are calibrated, and the unknown class takes what no family
claims with ``MIN_PROBABILITY``.  A prediction is confirmed if the paragraph holds enough of the n-grams of one of the family's notices.
Every paragraph is searched for the model's n-grams, as notices also have lines without a cue word; one without any has no feature and is known to be
unknown without being scored.  Cues only choose paragraphs that the training samples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stage

NEGATIVE_ROWS = 2000
MIN_PROBABILITY = 0.7
CONFIRM_FROM = 0.6
#: Paragraphs with one of these are the negatives that the training samples.
CUES = ("licen", "copyright", "public domain", "spdx", "warranty", "redistribut", "permission is hereby")

# Common public licence notices by family.
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL version 3 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "The author dedicates this work to the public domain under the CC0 1.0 licence.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
}
_MISLEADING = (
    "A driving licence is required to rent a car.", "The licence fee was raised again this year.", "He got his fishing license in spring.",
    "Copyright disputes fill the courts.", "All rights reserved.", "Copyright 2020 by the author, all rights reserved.",
    "The warranty covers two years from the date of purchase.", "Wealth was redistributed in the reform.", "The bar lost its license to sell alcohol.",
    "This license is proprietary and confidential.", "Licensed under the terms agreed with the customer.", "The public domain is a legal idea.",
    "Licensed premises close at midnight.", "Released under pressure from the public.", "This work is licensed to no one.",
)
UNKNOWN = "unknown"


def tokens(paragraph: Column) -> Column:
    """Lower-case words of letters, digits and dots before one of these."""
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"[.]?[a-z0-9]++(?:[.][a-z0-9]++)*+"), F.lit(0))


def known_grams(words: Column, vocabulary: list[str]) -> Column:
    """The distinct words and word pairs that are in the vocabulary, words first; a pair is only made of words that pairs of the vocabulary have."""
    single, double = [g for g in vocabulary if " " not in g], [g for g in vocabulary if " " in g]
    first, second = (sorted({g.split(" ")[i] for g in double}) for i in (0, 1))
    pairs = F.zip_with(
        words, F.slice(words, F.lit(2), F.size(words) + 1), lambda a, b: F.when(a.isin(first) & b.isin(second), F.concat(a, F.lit(" "), b))
    )
    return F.array_distinct(F.concat(F.filter(words, lambda w: w.isin(single)), F.filter(pairs, lambda p: p.isin(double))))


_CUE = "(?i)" + "|".join(CUES)


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, paragraph, body): all paragraphs, here lines, that are not blank."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("paragraph", "body"))
    return lines.where(F.col("body").rlike(r"\S"))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, paragraph, body): the paragraphs with a cue, which the training samples."""
    return paragraphs(docs.where(F.col(text_col).rlike(_CUE)), id_col, text_col).where(F.col("body").rlike(_CUE))


@dataclass
class LicenceModel:
    vocabulary: list[str]
    classes: list[str]  # UNKNOWN first
    weights: np.ndarray  # (classes, vocabulary + 1), the intercepts last
    temperature: float
    notices: list[tuple[str, str, list[str]]]  # family, name, n-grams

    def probabilities(self, hits: list[list[int]]) -> np.ndarray:
        scores = np.array([self.weights[:, x].sum(axis=1) + self.weights[:, -1] for x in hits]) / self.temperature
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def _noisy(lists: list[list[str]], rng: np.random.Generator, copies: int) -> list[list[str]]:
    """Copies with words dropped, and with words of the other lists before or after."""
    pool = sorted({w for x in lists for w in x})
    out = []
    for words in lists:
        for n in range(copies):
            kept = [w for w in words if rng.random() > (0.0 if n == 0 else 0.08)]
            noise = [f"x{rng.integers(1 << 30)}" for _ in range(int(rng.integers(0, 4)))] if n % 2 else []
            out.append([*noise, *kept] if rng.random() < 0.5 else [*kept, *noise])
    assert pool
    return out


def _gram_list(words: list[str]) -> list[str]:
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", negative_rows: int = NEGATIVE_ROWS, steps: int = 300) -> LicenceModel:
    """Fit on noisy notices, misleading sentences and at most ``negative_rows`` cue paragraphs of the corpus that hold no notice."""
    spark, rng = docs.sparkSession, np.random.default_rng(3)
    texts = [(family, body) for family, bodies in NOTICES.items() for body in bodies] + [(UNKNOWN, body) for body in _MISLEADING]
    rows = spark.createDataFrame(texts, "family string, body string").select("family", "body", tokens(F.col("body")).alias("words")).collect()
    vocabulary = sorted({g for row in rows if row["family"] != UNKNOWN for g in _gram_list(row["words"])})
    slot = {g: i for i, g in enumerate(vocabulary)}
    classes = [UNKNOWN, *NOTICES]
    notices = [(row["family"], f"{row['family']}-{i}", _gram_list(row["words"])) for i, row in enumerate(rows) if row["family"] != UNKNOWN]
    # The corpus's own negatives: cue paragraphs with less than half of any notice's n-grams.  Only known n-grams leave the executors.
    own = candidates(docs, id_col, text_col).select(
        known_grams(tokens(F.col("body")), vocabulary).alias("hits"), F.xxhash64("body").alias("order")
    )
    far = stage(own, "licence-cues").where(F.greatest(*(_held(F.col("hits"), x) for _, _, x in notices)) < 0.5)
    sampled = far.orderBy("order", "hits").limit(negative_rows).select("hits").collect()

    def examples(copies: int) -> tuple[list[list[int]], np.ndarray]:
        hits, labels = [], []
        for family in classes:
            for words in _noisy([row["words"] for row in rows if row["family"] == family], rng, copies):
                hits.append([slot[g] for g in _gram_list(words) if g in slot])
                labels.append(classes.index(family))
        return hits, np.array(labels)

    hits, labels = examples(24)
    hits += [[slot[g] for g in row["hits"]] for row in sampled] + [[]] * 50
    labels = np.concatenate([labels, np.zeros(len(sampled) + 50, int)])
    x = np.zeros((len(hits), len(vocabulary) + 1))
    for i, known in enumerate(hits):
        x[i, known] = 1
    x[:, -1] = 1
    share = 1 / np.bincount(labels, minlength=len(classes))[labels]
    weights, velocity = np.zeros((len(classes), x.shape[1])), np.zeros((len(classes), x.shape[1]))
    for _ in range(steps):
        odds = np.exp((scores := x @ weights.T) - scores.max(axis=1, keepdims=True))
        error = odds / odds.sum(axis=1, keepdims=True)
        error[np.arange(len(labels)), labels] -= 1
        velocity = 0.9 * velocity - 0.3 * ((error * share[:, None]).T @ x / len(classes))
        weights += velocity
        weights[:, :-1] = np.sign(weights[:, :-1]) * np.maximum(np.abs(weights[:, :-1]) - 2e-4, 0)  # sparse
    model = LicenceModel(vocabulary, classes, weights, 1.0, notices)
    held, truth = examples(9)
    losses = {}
    for temperature in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        model.temperature = temperature
        losses[temperature] = -np.log(np.maximum(model.probabilities(held)[np.arange(len(truth)), truth], 1e-9)).mean()
    model.temperature = min(losses, key=losses.get)
    return model


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _held(found: Column, notice: list[str]) -> Column:
    """Share of a notice's n-grams among those found."""
    return F.size(F.array_intersect(found, _strings(notice))) / F.lit(float(len(notice)))


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph with a cue or any of the model's n-grams: (id, paragraph, family, probability, notice, similarity, confirmed).

    ``family`` is ``unknown`` if no family reaches ``MIN_PROBABILITY``; ``notice`` is then null, and nothing is confirmed.  ``similarity`` is the share of
    the closest notice's n-grams that the paragraph holds, the first of equally close ones.  Null and empty texts have no paragraph.
    Repeated rows give repeated results; null ids are returned as such.  An empty table gives no rows; other columns are not read.
    """
    families = model.classes[1:]
    by_gram = {g: model.weights[:, i] / model.temperature for i, g in enumerate(model.vocabulary) if np.any(model.weights[:, i])}
    known = paragraphs(docs, id_col, text_col).select(
        "id", F.col("paragraph").cast("long").alias("paragraph"), F.col("body").rlike(_CUE).alias("cue"), known_grams(tokens(F.col("body")), model.vocabulary).alias("hits")
    )
    # Exploded and not filtered, as a filter would be pushed below and look up all n-grams once more.
    found = known.select("id", "paragraph", F.explode(F.filter(F.array("hits"), lambda h: F.col("cue") | (F.size(h) > 0))).alias("hits"))
    table = F.create_map(*(x for g, w in by_gram.items() for x in (F.lit(g), F.array(*map(F.lit, w.tolist())))))
    start = F.array(*map(F.lit, (model.weights[:, -1] / model.temperature).tolist()))
    scores = F.aggregate(
        "hits", start, lambda total, g: F.zip_with(total, F.coalesce(F.element_at(table, g), F.array_repeat(F.lit(0.0), len(model.classes))), lambda a, b: a + b)
    )
    odds = F.transform("scores", lambda x: F.exp(x - F.array_max("scores")))
    scored = found.withColumn("scores", scores).withColumn("odds", odds).withColumn("total", F.aggregate("odds", F.lit(0.0), lambda a, b: a + b))
    best = F.array_max(F.slice("odds", 2, len(families)))
    ranked = scored.withColumn("probability", best / F.col("total")).withColumn(
        "guess", F.element_at(F.array(*map(F.lit, families)), F.array_position(F.slice("odds", 2, len(families)), best).cast("int"))
    ).withColumn("sure", F.col("probability") >= MIN_PROBABILITY)
    near = F.array(*(
        F.struct(F.when(F.col("guess") == family, _held(F.col("hits"), x)).otherwise(-1.0).alias("similarity"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (family, name, x) in enumerate(model.notices)
    ))
    close = ranked.withColumn("near", F.array_max(near))
    return close.select(
        F.col("id").alias(id_col), "paragraph", F.when(F.col("sure"), F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability",
        F.when(F.col("sure"), F.col("near.name")).alias("notice"), F.col("near.similarity").alias("similarity"),
        (F.col("sure") & (F.col("near.similarity") >= CONFIRM_FROM)).alias("confirmed"),
    )
