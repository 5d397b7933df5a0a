"""Licence families of paragraphs: a sparse word n-gram logistic regression, confirmed by templates.

The model is multinomial over families and an unknown class.  It is trained on the driver
from the templates below, thinned and mixed with other words, and from sentences that
mention licences without granting one; a temperature fitted on rows it has not seen
calibrates its probabilities.  A prediction stands only if enough of the family's template
phrases occur in the paragraph, else the family is unknown.

A paragraph ends at a line without letters or digits; its rows are named by the line where a
notice starts.  A line is judged alone first; one that isn't confirmed alone is judged with the
words behind it in its paragraph, as many as twice the longest template has, and takes their
family if these words aren't confirmed without it.  So wrapped notices count where they start,
comment marks around them fall away with all that isn't a letter or a digit, and a long
paragraph may hold several notices.  Words are left out before scoring only if they hold none
of ``template_words()``, without which no template can be confirmed.  Equal texts are scored
once and joined back.  Scoring has column expressions alone.

Defined results: a null or empty text has no paragraphs; a paragraph that no template
confirms has family ``unknown``; equal probabilities go to the family first in order;
repeated rows each get theirs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import if_small, saved

UNKNOWN = "unknown"
#: Customary notices by family, as their licences word them.
TEMPLATES = {
    "agpl": (
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license",
        "spdx license identifier agpl 3.0",
    ),
    "apache": (
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "see the license for the specific language governing permissions and limitations under the license",
        "spdx license identifier apache 2.0",
        "lizenziert unter der apache lizenz version 2.0",
        "sous licence apache version 2.0",
        "bajo la licencia apache versión 2.0",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "licensed under the bsd license",
        "use of this source code is governed by a bsd style license that can be found in the license file",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
        "spdx license identifier bsd 3 clause",
        "spdx license identifier bsd 2 clause",
    ),
    "cc-by": (
        "licensed under a creative commons attribution 4.0 international license",
        "licensed under cc by 4.0",
        "spdx license identifier cc by 4.0",
        "lizenz cc by 4.0",
        "sous licence cc by 4.0",
        "bajo licencia cc by 4.0",
    ),
    "cc-by-nc": (
        "licensed under cc by nc 4.0",
        "licensed under a creative commons attribution noncommercial 4.0 international license",
        "spdx license identifier cc by nc 4.0",
        "lizenz cc by nc 4.0",
        "sous licence cc by nc 4.0",
        "bajo licencia cc by nc 4.0",
    ),
    "cc-by-sa": (
        "licensed under cc by sa 4.0",
        "licensed under a creative commons attribution sharealike 4.0 international license",
        "text is available under the creative commons attribution sharealike license",
        "spdx license identifier cc by sa 4.0",
        "lizenz cc by sa 4.0",
        "sous licence cc by sa 4.0",
        "bajo licencia cc by sa 4.0",
    ),
    "cc0": (
        "dedicated to the public domain under cc0 1.0 universal",
        "released into the public domain",
        "this is free and unencumbered software released into the public domain",
        "waived all copyright and related or neighboring rights to this work",
        "spdx license identifier cc0 1.0",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "you should have received a copy of the gnu general public license along with this program",
        "spdx license identifier gpl 2.0",
        "spdx license identifier gpl 3.0",
        "lizenziert unter der gnu general public license version 3",
        "sous licence gnu general public license version 3",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license version 2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "spdx license identifier lgpl 2.1",
        "spdx license identifier lgpl 3.0",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the software is provided as is without warranty of any kind",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "spdx license identifier mit",
        "veröffentlicht unter der mit lizenz",
        "publié sous licence mit",
        "publicado bajo la licencia mit",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        "spdx license identifier mpl 2.0",
    ),
    "proprietary": (
        "copyright all rights reserved no part may be reproduced without permission",
        "all rights reserved",
        "no part may be reproduced without permission",
        "proprietary and confidential",
        "unauthorized copying of this file via any medium is strictly prohibited",
        "alle rechte vorbehalten",
        "tous droits réservés",
        "todos los derechos reservados",
    ),
}
#: Sentences that mention licences, rights or warranties and grant nothing.
OTHER = (
    "see the license for details",
    "his driving license was taken away",
    "the license fee is due at the end of the year",
    "the terms of the contract are subject to change",
    "ask for permission before you leave the room",
    "the copyright of the book is disputed in court",
    "the warranty of the car covers two years",
    "a fishing license is needed in this area under the law",
    "she was licensed as a nurse in this state",
    "public records are kept in the general office",
    "spdx license identifier zlib",
    "spdx license identifier isc",
    "identifier of the license plate",
    "you should have received a copy of the letter",
    "a free program of the public library",
    "the rights of all are reserved seats",
    "the source of the software was not named in the file",
)
CUES = r"(?i)li[cz]en[scz]|permission|copyright|warrant|redistribut|public\W+domain|rights\W+reserved"
#: Lengths of the n-grams in words, draws of training rows per template, and passes over them.
GRAMS, DRAWS, PASSES = (1, 2, 3), 30, 250
LEAST_PROBABILITY, LEAST_SIMILARITY = 0.5, 0.6
#: Words behind a line that are read along with it.
AHEAD = 2 * max(len(t.replace(".", " ").split()) for rows in TEMPLATES.values() for t in rows)


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in GRAMS for i in range(len(words) - n + 1)}


def _words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


COMMON = {"a", "an", "and", "any", "as", "by", "for", "in", "is", "it", "may", "no", "not", "of", "on", "or", "out", "that", "the", "this", "to", "under", "with", "without", "you", "be", "are", "all"}


def template_phrases() -> list[str]:
    """Pairs of words of which each text holds one that reaches LEAST_SIMILARITY to a template: of each
    template, those with the fewest common words, so many that the others stay below the limit."""
    taken = set()
    for words in (_words(t) for rows in TEMPLATES.values() for t in rows):
        pairs = sorted({tuple(words[i : i + 2]) for i in range(len(words) - 1)}, key=lambda x: (sum(w in COMMON for w in x), x))
        count = next(k for k in range(len(pairs) + 1) if len(pairs) - k < LEAST_SIMILARITY * len(pairs))
        taken |= {" ".join(x) for x in pairs[:count]}
    return sorted(taken)


def template_words() -> list[str]:
    """Words of which each text holds one that reaches LEAST_SIMILARITY to a template.

    Words are taken, the rarest in OTHER and the most useful first, until the phrases of each
    template that hold none of them stay below the limit.
    """
    templates = [{tuple(words[i : i + 2]) for i in range(len(words) - 1)} for rows in TEMPLATES.values() for t in rows for words in [_words(t)]]
    plain = [w for t in OTHER for w in _words(t)]
    taken: list[str] = []
    while open_ := [left for pairs in templates if len(left := {x for x in pairs if not set(x) & set(taken)}) >= LEAST_SIMILARITY * len(pairs)]:
        found = {w for left in open_ for x in left for w in x}
        taken.append(max(sorted(found), key=lambda w: (w not in COMMON and not w.isdigit(), sum(w in x for left in open_ for x in left) / (1 + plain.count(w)))))
    return sorted(taken)


class Model:
    """``weights``: an n-gram's score for each class; ``bias``; ``phrases``: (family, template, phrase)."""

    def __init__(self, seed: int = 11):
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        self.phrases = [
            (family, f"{family} {k}", " ".join(words[i : i + 2]))
            for family in sorted(TEMPLATES)
            for k, template in enumerate(TEMPLATES[family])
            for words in [_words(template)]
            for i in range(len(words) - 1)
        ]
        vocabulary = sorted({g for rows in (*TEMPLATES.values(), OTHER) for t in rows for g in _grams(_words(t))})
        chooser = random.Random(seed)
        rows, classes = self._training_rows(chooser)
        index = {g: i for i, g in enumerate(vocabulary)}
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for r, words in enumerate(rows):
            x[r, [index[g] for g in _grams(words) if g in index]] = 1.0
        y = np.eye(len(self.families))[classes]
        apart = np.arange(len(rows)) % 4 == 0
        weights, self.bias = self._fit(x[~apart], y[~apart])
        self.temperature = self._calibrate(x[apart] @ weights + self.bias, y[apart])
        self.weights = {g: w for g, w in zip(vocabulary, weights.tolist(), strict=True) if max(map(abs, w)) > 1e-3}

    def _training_rows(self, chooser: random.Random) -> tuple[list[list[str]], list[int]]:
        filler = sorted({w for t in OTHER for w in _words(t)} - {"license", "licensed"})
        rows, classes = [], []

        def draw(words: list[str], keep: float) -> list[str]:
            kept = [w for w in words if chooser.random() < keep]
            around = [chooser.choice(filler) for _ in range(chooser.randrange(12))]
            cut = chooser.randrange(len(around) + 1)
            return around[:cut] + kept + around[cut:]

        for k, family in enumerate(self.families[:-1]):
            for template in TEMPLATES[family]:
                for _ in range(DRAWS):
                    rows.append(draw(_words(template), 0.95))
                    classes.append(k)
        # Scattered words of a template alone are no licence.
        every = [_words(t) for rows_ in TEMPLATES.values() for t in rows_]
        for words in [*(_words(t) for t in OTHER), *every]:
            for _ in range(DRAWS // 2):
                if words in every:
                    words = chooser.sample(words, max(1, len(words) // 4))
                rows.append(draw(words, 0.9))
                classes.append(len(self.families) - 1)
        return rows, classes

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, rate: float = 0.5, ridge: float = 1e-4, lasso: float = 5e-5) -> tuple[np.ndarray, np.ndarray]:
        """Softmax regression by proximal gradient steps: small weights become zero."""
        w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        y = y.astype(np.float32)
        for _ in range(PASSES):
            error = _softmax(x @ w + b) - y
            w -= rate * (x.T @ error / len(x) + ridge * w)
            w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0)
            b -= rate * error.mean(0)
        return w, b

    @staticmethod
    def _calibrate(margins: np.ndarray, y: np.ndarray) -> float:
        choices = np.geomspace(0.25, 4, 33)
        losses = [-np.log((_softmax(margins / t) * y).sum(1) + 1e-12).mean() for t in choices]
        return float(choices[int(np.argmin(losses))])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def paragraphs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, paragraph (number of the line where it starts), cue, norm (its words), ahead (the words behind it) and both
    together, of the lines that hold a cue or may start a notice."""
    words = rf"(?i)(?:^|[^a-z0-9])(?:{'|'.join(template_words())})(?:$|[^a-z0-9])"
    texts = docs.where(F.col(text_column).rlike(CUES) | F.col(text_column).rlike(words))
    lines = texts.select(F.col(id_column).cast("long").alias("doc_id"), F.split(text_column, "\n").alias("raw"))
    lines = lines.withColumn("norms", F.transform("raw", lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))))
    # Lines that hold words, so that AHEAD of them hold AHEAD words.
    lines = lines.withColumn("full", F.filter(F.transform("norms", lambda x, i: F.struct(i.alias("at"), x.alias("norm"))), lambda x: x["norm"] != ""))

    def window(x: Column, k: Column) -> Column:
        # Lines follow each other without a gap as long as their numbers do.
        near = F.filter(F.slice("full", k + 2, AHEAD), lambda y, i: y["at"] == x["at"] + i + 1)
        ahead = F.substring_index(F.array_join(F.transform(near, lambda y: y["norm"]), " "), " ", AHEAD)
        return F.struct(x["at"].cast("long").alias("paragraph"), F.element_at("raw", x["at"] + 1).rlike(CUES).alias("cue"), x["norm"].alias("norm"), ahead.alias("ahead"))

    def both(x: Column) -> Column:
        return F.concat_ws(" ", x["norm"], F.when(x["ahead"] != "", x["ahead"]))

    # A line's row holds its own window and never the text: long texts have many lines.
    may_start = rf"(?:^| )(?:{'|'.join(template_phrases())})(?:$| )"
    found = F.filter(F.transform("full", window), lambda x: x["cue"] | both(x).rlike(may_start))
    return lines.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*", both(F.col("x")).alias("both"))


def _gram_column(words: Column, n: int) -> Column:
    """The distinct n-grams of an array of words."""
    if n == 1:
        return words
    count = F.size(words) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, model: Model | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each paragraph with a cue or a confirmed family: doc_id, paragraph, family, probability, similarity.

    ``probability`` is that of the most likely class, ``similarity`` the share of the best
    template's phrases (pairs of words) that occur.
    """
    model = model or Model()
    spark = docs.sparkSession
    found = saved(paragraphs(docs, id_column, text_column), "licence-paragraphs")
    every = found.select("norm").union(found.select("ahead")).union(found.select("both"))
    unique = saved(every.where("norm <> ''").distinct().withColumn("words", F.split("norm", " ")), "licence-unique")
    grams = unique.select("norm", F.explode(F.array_distinct(F.concat(*[_gram_column(F.col("words"), n) for n in GRAMS]))).alias("gram"))
    # Both tables are bounded by the templates.
    weights = spark.createDataFrame(list(model.weights.items()), "gram string, weights array<double>")
    phrases = spark.createDataFrame(model.phrases, "family string, template string, gram string").distinct()
    totals = phrases.groupBy("family", "template").agg(F.count("*").alias("phrases"))

    classes = len(model.families)
    sums = [F.coalesce(F.sum(F.element_at("weights", k + 1)), F.lit(0.0)) for k in range(classes)]
    margins = grams.join(F.broadcast(weights), "gram").groupBy("norm").agg(F.array(*[(s + float(b)) / model.temperature for s, b in zip(sums, model.bias, strict=True)]).alias("margins"))
    top = F.array_max("margins")
    best = F.array_position("margins", top)
    scored = margins.select(
        "norm",
        F.element_at(F.lit(model.families), best.cast("int")).alias("family"),
        (1 / F.aggregate(F.transform("margins", lambda m: F.exp(m - F.array_max("margins"))), F.lit(0.0), lambda a, e: a + e)).alias("probability"),
    )
    shares = (
        grams.join(F.broadcast(phrases), "gram")
        .groupBy("norm", "family", "template")
        .agg(F.count("*").alias("hits"))
        .join(F.broadcast(totals), ["family", "template"])
        .groupBy("norm", "family")
        .agg(F.max(F.col("hits") / F.col("phrases")).alias("similarity"))
    )
    judged = scored.join(shares, ["norm", "family"], "left").select("norm", "family", "probability", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    sure = (F.col("probability") >= LEAST_PROBABILITY) & (F.col("similarity") >= LEAST_SIMILARITY)
    judged = saved(judged.withColumn("family", F.when(sure, F.col("family")).otherwise(UNKNOWN)), "licence-judged")
    names = ["family", "probability", "similarity"]
    known = judged.where(F.col("family") != UNKNOWN)
    known = if_small(known, known.count(), 512)

    def of(column: str) -> DataFrame:
        return known.select(F.col("norm").alias(column), *[F.col(c).alias(f"{column}_{c}") for c in names])

    # A line alone comes first; what stays unknown keeps the line's own figures.
    rows = found.join(of("norm"), "norm", "left").join(of("both"), "both", "left").join(of("ahead"), "ahead", "left")
    starts = F.col("norm_family").isNull() & F.col("both_family").isNotNull() & ~F.col("both_family").eqNullSafe(F.col("ahead_family"))
    rows = rows.withColumn("scored", F.when(starts, F.col("both")).otherwise(F.col("norm"))).where(F.col("cue") | starts | F.col("norm_family").isNotNull())
    rows = rows.select("doc_id", "paragraph", F.col("scored").alias("norm"))
    return rows.join(if_small(judged, judged.count(), 512), "norm", "left").select(
        "doc_id",
        "paragraph",
        F.coalesce("family", F.lit(UNKNOWN)).alias("family"),
        F.round(F.coalesce("probability", F.lit(1.0)), 6).alias("probability"),
        F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"),
    )
