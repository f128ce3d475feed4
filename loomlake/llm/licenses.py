"""Licence scans: a trained paragraph classifier over sparse word n-grams, with template comparison.

A multinomial logistic regression over the presence of word n-grams is trained on pieces of the templates below (a class
for each family), and for the class none on shuffled templates and on at most NEGATIVES paragraphs of the corpus, chosen by
hashes. All n-grams of the templates are features. Every paragraph is scored but those that cannot come out as a licence's:
from the weights follows how much each word, with the n-grams that it is the rarest word of, can add at most, and words
that can't tip the scales together are weak; a paragraph of weak and unknown words only is the class none's.

A family needs a probability that held-out pieces of its templates reach, and a likeness to one of its templates that
other licences don't: whole templates whose own family is left out say how like the next best family a licence can be that
isn't among the families. Else the family is unknown.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import cut

# Phrases by which licences are named and granted.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT license", "This project is licensed under the terms of the MIT License", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache 2.0 license",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD": (
        "Released under the BSD License.", "Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL version 2 or later", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ),
    "MPL": (
        "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under the CC0 1.0 Universal license", "SPDX-License-Identifier: CC0-1.0"),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Proprietary": ("All rights reserved. This material is confidential and proprietary.", "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.", "All rights reserved.", "Unauthorized copying of this file is strictly prohibited."),
}
FAMILIES = (*TEMPLATES, "none")
NEGATIVES = 2000
NGRAMS = 3
#: Words of a template's pieces besides whole templates, and every which place a piece begins at.
PIECE_WORDS, PIECE_STEP = (6, 10), 2
#: The part of held-out pieces whose own family must reach its limit, and of left-out templates that must stay unknown.
HELD_OUT_PART = 0.95
LEAST_LICENSE = 0.5
#: Share of a sampled paragraph's threes of words that templates hold, from which on it may be a licence's itself.
OWN = 0.5
ROUNDS, PENALTY = 100, 0.0002
#: Weight of a whole template against a piece; classes weigh the same together.
WHOLE = 4.0
SHUFFLES = 2


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9]+"), "")


def grams(w: Column, n: int) -> Column:
    """Distinct runs of n words."""
    return F.array_distinct(F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda _, i: F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))


def all_grams(w: Column) -> Column:
    return F.flatten(F.array(*(grams(w, n) for n in range(1, NGRAMS + 1))))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = F.posexplode(F.split(F.coalesce(docs[text_col], F.lit("")), "\n")).alias("line", "paragraph")
    return docs.select(docs[id_col].alias("doc_id"), lines)


def _template_table(spark: SparkSession) -> DataFrame:
    """family, w of each template."""
    rows = [(f, t) for f, texts in TEMPLATES.items() for t in texts]
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("select * from values " + ", ".join(f"({quote(f)}, {quote(t)})" for f, t in rows) + " as t(family, text)").select("family", words(F.col("text")).alias("w"))


def _template_rows(spark: SparkSession) -> DataFrame:
    """family, w, held, weight: whole templates, pieces of them, every fifth held out, and shuffled templates as none."""
    table = _template_table(spark)
    rows = table.select("family", "w", F.lit(False).alias("held"), F.lit(WHOLE).alias("weight"))
    for n in PIECE_WORDS:
        at = table.filter(F.size("w") > n).select("family", "w", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1, F.lit(PIECE_STEP))).alias("at"))
        rows = rows.unionByName(at.select("family", F.slice("w", F.col("at"), F.lit(n)).alias("w"), F.pmod(F.xxhash64("family", "at", F.lit(n)), F.lit(5)).eqNullSafe(0).alias("held"), F.lit(1.0).alias("weight")))
    for n in range(SHUFFLES):
        mixed = F.transform(F.array_sort(F.transform("w", lambda x, i: F.struct(F.xxhash64(x, i, F.lit(n)).alias("h"), x.alias("x")))), lambda p: p["x"])  # noqa: B023
        rows = rows.unionByName(table.withColumn("mixed", mixed).filter("mixed <> w").select(F.lit("none").alias("family"), F.col("mixed").alias("w"), F.lit(False).alias("held"), F.lit(1.0).alias("weight")))
    return rows


def _likeness(threes: Column, templates: Column) -> Column:
    """The largest share that a template's threes have in a paragraph's, or those in the template's."""
    common = lambda t: F.size(F.array_intersect(threes, t))
    each = F.transform(templates, lambda t: F.coalesce(F.try_divide(common(t), F.least(F.size(threes), F.size(t))), F.lit(0.0)))
    return F.round(F.array_max(each), 6)


def _by_family(spark: SparkSession) -> DataFrame:
    """A row for each family: _family, and the threes of each of its templates."""
    return _template_table(spark).groupBy(F.col("family").alias("_family")).agg(F.collect_list(grams(F.col("w"), NGRAMS)).alias("templates"))


def _sample(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """w of NEGATIVES different paragraphs at most, from documents that are chosen by their texts' hashes; not those like templates."""
    every = max(1, docs.count() // NEGATIVES)
    some = docs.filter(F.pmod(F.xxhash64(docs[text_col], F.lit(5)), F.lit(every)) == 0)
    hashed = paragraphs(some, id_col, text_col).select("paragraph").filter(F.length("paragraph") > 0).withColumn("h", F.xxhash64("paragraph", F.lit(5)))
    sample = cut(hashed.distinct().orderBy("h", "paragraph").limit(NEGATIVES).select(words(F.col("paragraph")).alias("w")).filter(F.size("w") > 0), "license-sample")
    told = [r.t for r in known.select(F.explode("templates").alias("t")).select(F.explode("t").alias("t")).distinct().collect()]  # of the constant templates
    threes = grams(F.col("w"), NGRAMS)
    return sample.filter(F.size(F.filter(threes, lambda x: x.isin(told))) <= OWN * F.size(threes))


class Model:
    """The fitted stages, and what else a scan needs."""

    def __init__(self, counter, regression, limit: float, like: float):
        self.counter, self.regression, self.limit, self.like = counter, regression, limit, like
        self.bias = [float(x) for x in regression.interceptVector]
        matrix = regression.coefficientMatrix.toArray()
        self.weights = {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(counter.vocabulary)}  # of the constant templates

    def strong(self, common: dict[str, int]) -> list[str]:
        """Words one of which a paragraph needs to come out as a licence's. common: how often words occur in a sample.

        A gram adds to a family's lead over none at most the most that it adds to any family's. Each gram is put down to
        its least common word. As many of the commonest words are weak as can't make up for none's lead together.
        """
        adds: dict[str, float] = {}
        for gram, w in self.weights.items():
            word = min(gram.split(" "), key=lambda x: (common.get(x, 0), x))
            adds[word] = adds.get(word, 0.0) + max(0.0, max(w[:-1]) - w[-1])
        need = math.log(LEAST_LICENSE / (1 - LEAST_LICENSE)) - math.log(sum(math.exp(b - self.bias[-1]) for b in self.bias[:-1])) - 1e-6
        order = sorted(adds, key=lambda x: (-common.get(x, 0), x))
        while order and adds[order[0]] <= need:
            need -= adds[order.pop(0)]
        return sorted(order) if need > 0 else sorted(g for g in self.weights if " " not in g)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, list[str]]:
    """The model and the words one of which a paragraph must have to be scored: strong ones, or any that templates have."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    spark = docs.sparkSession
    known = _by_family(spark)
    named = cut(_template_rows(spark), "license-templates")
    sample = _sample(docs, known, id_col, text_col)
    plain = cut(sample.select(F.lit("none").alias("family"), "w", F.lit(False).alias("held"), F.lit(1.0).alias("weight")), "license-none")
    label = F.array_position(F.array(*(F.lit(f) for f in FAMILIES)), F.col("family")).cast("double") - 1
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("family", "held"))
    rows = cut(named.unionByName(plain).select("family", "held", label.alias("label"), "w", all_grams(F.col("w")).alias("grams"), share.alias("weight")).coalesce(1), "license-training")
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(rows.filter("not held and family <> 'none'"))
    spread = counter.transform(rows)
    regression = LogisticRegression(maxIter=ROUNDS, regParam=PENALTY, family="multinomial", standardization=False, weightCol="weight").fit(spread.filter("not held").coalesce(1))

    scored = regression.transform(spread.filter("family <> 'none'")).select("family", "held", "label", "w", "weight", vector_to_array("probability").alias("p"))
    own = sorted(r.x for r in scored.filter("held").select(F.element_at("p", F.col("label").cast("int") + 1).alias("x")).collect())  # pieces of the constant templates
    limit = own[math.floor((1 - HELD_OUT_PART) * len(own))] if own else 0.5
    whole = scored.join(_template_table(spark), ["family", "w"], "left_semi").select("family", "w", F.transform(F.slice("p", 1, len(TEMPLATES)), lambda x, i: F.when(i == F.col("label").cast("int"), -1.0).otherwise(x)).alias("p"))
    guess = F.element_at(F.array(*(F.lit(f) for f in TEMPLATES)), F.array_position("p", F.array_max("p")).cast("int"))
    left_out = whole.withColumn("guess", guess).join(F.broadcast(known), F.col("guess") == F.col("_family"))
    others = sorted(r.x for r in left_out.select(_likeness(grams(F.col("w"), NGRAMS), F.col("templates")).alias("x")).collect())
    like = others[min(len(others) - 1, math.ceil(HELD_OUT_PART * len(others)) - 1)]
    model = Model(counter, regression, limit, like)
    common = {r.x: r.n for r in plain.select(F.explode(F.array_distinct("w")).alias("x")).filter(F.col("x").isin([g for g in model.weights if " " not in g])).groupBy("x").agg(F.count("*").alias("n")).collect()}  # words of the constant templates
    return model, model.strong(common)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line, family, probability, similarity, confirmed, paragraph of each paragraph that is likely a licence's.

    A paragraph is a line; line counts from 0. probability is that of the best family, of equal ones the first in the order
    of FAMILIES; a family is unknown unless it reaches the model's limit and is more like a template than left-out licences
    are. Null and empty texts give no rows, neither does an empty table; repeated rows give theirs each; null ids stay null;
    paragraphs of any length are scored whole; other columns are not read.
    """
    from pyspark.ml.feature import NGram
    from pyspark.ml.functions import vector_to_array

    model, strong = train(docs, id_col, text_col)
    own = lambda c, name: F.explode(F.array(c)).alias(name)  # noqa: E731 - worked out once, however often it is used
    rows = paragraphs(docs, id_col, text_col).select("*", own(words(F.col("paragraph")), "w"))
    rows = rows.filter(F.exists("w", lambda x: x.isin(strong)))
    for n in range(2, NGRAMS + 1):
        rows = NGram(n=n, inputCol="w", outputCol=f"g{n}").transform(rows)
    rows = model.counter.transform(rows.select("doc_id", "line", "paragraph", "w", F.concat("w", *(f"g{n}" for n in range(2, NGRAMS + 1))).alias("grams")))
    scored = model.regression.transform(rows.select("doc_id", "line", "paragraph", "w", "features"))
    scored = scored.select("doc_id", "line", "paragraph", "w", own(vector_to_array("probability"), "p")).filter(1 - F.element_at("p", -1) >= LEAST_LICENSE)
    scored = scored.select("*", own(F.slice("p", 1, len(TEMPLATES)), "named")).withColumn("best", F.array_position("named", F.array_max("named")).cast("int"))
    found = scored.select("doc_id", "line", "paragraph", "w", F.element_at(F.array(*(F.lit(f) for f in TEMPLATES)), F.col("best")).alias("guess"), F.element_at("named", F.col("best")).alias("probability"))
    found = found.join(F.broadcast(_by_family(docs.sparkSession)), F.col("guess") == F.col("_family"))  # a row for each family
    found = found.withColumn("similarity", _likeness(grams(F.col("w"), NGRAMS), F.col("templates")))
    confirmed = (F.col("probability") >= model.limit) & (F.col("similarity") > model.like)
    return found.select("doc_id", "line", F.when(confirmed, F.col("guess")).otherwise("unknown").alias("family"), F.round("probability", 6).alias("probability"), "similarity", confirmed.alias("confirmed"), "paragraph")
