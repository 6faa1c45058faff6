"""Licence scan: a trained paragraph classifier with template confirmation.

A paragraph is a line with a word.  Multinomial logistic regression over hashed word unigrams
and bigrams is trained on pieces of licence notices (one class per family) and on a bounded
sample of ordinary paragraphs (class unknown).  The margin of the best family over unknown is
calibrated to a probability on rows kept out of training; below one half a paragraph stays
unknown.  A prediction counts when the paragraph also resembles the family's templates.
Everything runs in DataFrame and Spark ML operators on the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crosspanel.llm.frames import row_key, staged
from crosspanel.llm.quality import let

UNKNOWN = "unknown"
FEATURES = 1 << 13
#: Lines of at most so many words are compared by two-word grams, of which a single odd word takes fewer.
SHORT = 5

#: Notices by licence family, as their licences word them.
TEMPLATES: dict[str, list[str]] = {
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Except where otherwise noted, content is licensed under CC BY 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Except where otherwise noted, content is licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-nc-nd": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Except where otherwise noted, content is licensed under CC BY-NC-ND 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ],
    "cc-by-nc-sa": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Except where otherwise noted, content is licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ],
    "cc-by-nd": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Except where otherwise noted, content is licensed under CC BY-ND 4.0.",
        "Licensed under CC BY-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters and digits, with inner dots and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def grams(words: Column, n: int) -> Column:
    """Distinct word n-grams; fewer words give the whole sequence, none an empty array."""
    many = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[words[i + k] for k in range(n)]))
    return F.when(F.size(words) >= n, F.array_distinct(many)).when(F.size(words) > 0, F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(key, paragraph number, words) of every line with a word.

    The words are made inside the generator: later filters then refer to them as a column and
    can't pull their expression into the loops over n-grams.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), words_of)
    return docs.select(row_key().alias("key"), F.posexplode(lines).alias("paragraph", "words")).where(F.size("words") > 0)


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, text string").select("family", words_of(F.col("text")).alias("words"))


def _features(df: DataFrame) -> DataFrame:
    terms = df.withColumn("terms", F.concat("words", F.when(F.size("words") > 1, grams(F.col("words"), 2)).otherwise(F.array().cast("array<string>"))))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features").transform(terms).drop("terms")


@dataclass
class LicenceModel:
    families: list[str]
    classifier: LogisticRegressionModel
    slope: float
    offset: float

    def probability(self, margin: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * margin + F.lit(self.offset))))


def _margins(model: LogisticRegressionModel, families: list[str], rows: DataFrame) -> DataFrame:
    """``best``: the best family and its raw margin over the class unknown (label 0).

    One struct from one expression: columns that refer to the raw scores one by one would
    have the model evaluated again for each.
    """
    names = F.array(*[F.lit(f) for f in families])

    def best(raw: Column) -> Column:
        licences = F.slice(raw, 2, len(families))
        top = F.array_max(licences)
        return F.struct(F.element_at(names, F.array_position(licences, top).cast("int")).alias("family"), (top - raw[0]).alias("margin"))

    scored = model.transform(rows)
    return scored.withColumn("best", let(vector_to_array(F.col("rawPrediction")), best)).drop("rawPrediction", "probability", "prediction", "features")


def fit(docs: DataFrame, ordinary: int = 2000, documents: int = 8000) -> LicenceModel:
    """Train on pieces of the templates and at most ``ordinary`` paragraphs of the corpus.

    About ``documents`` documents are drawn by the remainder of their hash; of their distinct
    paragraphs without the words licence, license or copyright, and without four words in a row
    of a notice (which needn't say licence), those with the smallest hashes are taken, so what
    meets in one task doesn't grow with the corpus.  Rows that repeat, and
    paragraphs that many documents share, count once.  One row in five is kept out of training
    and calibrates the margin; whole notices always train.
    """
    spark = docs.sparkSession
    families = sorted(TEMPLATES)
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double")
    words = F.col("words")
    # Whole notices and their pieces of 4 to 12 words, so that quoted parts are known too.
    piece = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.slice(words, i, n))
    pieces = _templates(spark).select(label.alias("label"), F.posexplode(F.concat(F.array(words), piece(4), piece(8), piece(12))).alias("place", "words"))
    pieces = pieces.groupBy("label", "words").agg((F.min("place") == 0).alias("whole"))
    marked = F.exists(words, lambda w: w.rlike("licen[cs]e|copyright|warrant|redistribut"))
    rows_in_all = max(docs.count(), 1)
    drawn = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rows_in_all)) < documents)
    quoted = F.array(*[F.lit(g) for g in sorted(r[0] for r in _templates(spark).select(F.explode(grams(words, 4))).distinct().collect())])
    plain = paragraphs(drawn).where(~marked).select("words", F.xxhash64("words").alias("h")).dropDuplicates(["h"])
    plain = plain.where(~F.arrays_overlap(grams(words, 4), quoted)).orderBy("h").limit(ordinary)
    rows = pieces.unionByName(plain.select(F.lit(0.0).alias("label"), "words", F.lit(False).alias("whole")))
    rows = rows.withColumn("fold", F.when(F.col("whole"), F.lit(1)).otherwise(F.pmod(F.xxhash64("words", "label"), F.lit(5)))).drop("whole")
    rows = staged(rows.coalesce(1), "licence-training")
    # Classes weigh the same in total, so that a family of few notices isn't outvoted by its prior.
    sizes = rows.groupBy("label").agg((1.0 / F.count("*")).alias("share"))
    weights = rows.join(sizes, "label").withColumn("weight", F.col("share") * rows.count() / (len(families) + 1)).drop("share")
    rows = _features(staged(weights.coalesce(1), "licence-weights"))
    learner = LogisticRegression(regParam=1e-3, maxIter=40, family="multinomial", weightCol="weight")
    classes = len(families) + 1
    first = learner.fit(rows.where("fold <> 0"))
    held = _margins(first, families, rows.where("fold = 0")).select((F.col("label") > 0).cast("double").alias("label"), "best.margin") if first.numClasses == classes else None
    slope, offset = 1.0, 0.0
    if held is not None and held.select("label").distinct().count() == 2:
        scale = LogisticRegression(regParam=1e-2, maxIter=50).fit(VectorAssembler(inputCols=["margin"], outputCol="features").transform(held))
        slope, offset = float(scale.coefficients[0]), float(scale.intercept)
    return LicenceModel(families, first, slope, offset)


def scan(docs: DataFrame, model: LicenceModel, least: float = 0.5, similar: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, licences (sorted families) and hits.

    A hit is (paragraph, family, probability, similarity, confirmed) of a paragraph that isn't
    unknown; ``licences`` holds the families of confirmed hits.  Similarity is the larger of the
    share of the paragraph's word grams (three words, two in short paragraphs) that the family's templates have and the largest
    share of one template's grams that the paragraph has.  Null and empty texts have no
    paragraphs.  Repeated rows get equal results.  Of families with equal margins the first
    by name counts.
    """
    spark = docs.sparkSession
    shapes = _templates(spark).groupBy("family").agg(*[F.collect_list(grams(F.col("words"), n)).alias(f"templates{n}") for n in (2, 3)])
    scored = _margins(model.classifier, model.families, _features(paragraphs(docs.select("doc_id", "text"))))
    likely = scored.withColumn("p", model.probability(F.col("best.margin"))).where(F.col("p") >= least)
    # Few paragraphs pass; written, they are compared without scoring all others again.
    likely = staged(likely.select("key", "paragraph", "words", "best.family", "p"), "licence-likely")
    short = F.size("words") <= SHORT
    own = F.when(short, grams(F.col("words"), 2)).otherwise(grams(F.col("words"), 3)).alias("own")
    compared = likely.join(shapes, "family").select("key", "paragraph", "family", "p", own, F.when(short, F.col("templates2")).otherwise(F.col("templates3")).alias("templates"))
    known = F.size(F.array_intersect("own", F.flatten("templates"))) / F.greatest(F.size("own"), F.lit(1))
    most = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("own"))) / F.greatest(F.size(t), F.lit(1))))
    hits = compared.select("key", "paragraph", "family", F.round("p", 4).alias("probability"), F.round(F.greatest(known, most), 4).alias("similarity"))
    hits = hits.withColumn("confirmed", F.col("similarity") >= similar).distinct()
    found = hits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("paragraph", "family", "probability", "similarity", "confirmed"))).alias("hits"))
    found = staged(found, "licence-hits").withColumnRenamed("key", "hit_key")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    base = docs.select("doc_id", row_key().alias("key"), F.size(lines).cast("long").alias("n_paragraphs"))
    none = F.array().cast(found.schema["hits"].dataType)
    joined = base.join(found, F.col("key") == F.col("hit_key"), "left").select("doc_id", "n_paragraphs", F.coalesce("hits", none).alias("hits"))
    licences = F.array_sort(F.array_distinct(F.transform(F.filter("hits", lambda h: h["confirmed"]), lambda h: h["family"])))
    return joined.select("doc_id", "n_paragraphs", F.array_join(licences, ",").alias("licences"), "hits")
