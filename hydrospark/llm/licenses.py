"""License scans with a trained paragraph classifier.

A text is cut into pieces: each line by itself, and every four adjacent lines joined up to a
blank line, so that a wrapped notice is seen whole; lines over ``LONG_LINE`` characters are cut
first.  A piece that holds one of MARKS goes to the classifier: a multinomial logistic
regression on its distinct word 1- and 2-grams with one class for each licence family and one
for "unknown", trained here on notices made from TEMPLATES in many settings and on sentences
that only sound like licences.  Probabilities are calibrated by a temperature fitted on whole
phrases that the calibrated model never saw; under ``LEAST_PROBABILITY`` the class is unknown.
A prediction is confirmed if the piece holds ``LEAST_SHARED`` of the n-grams of a template
of that family; templates of up to three words count by their words alone, in any order.

Everything over the corpus is DataFrame functions.  The model is a table of n-grams with
their weights, a few thousand rows whatever the corpus, broadcast to the candidates'
n-grams.  It is fitted once for an application; ``save`` and ``load`` keep it longer.

Scale: one pass over the texts, in which most are dismissed by a search for MARKS; only
candidate pieces are written, split and joined, each on its own, so a licence line in a third
of all documents is no group.

Defined results: a null or empty text has no candidate and licence ``none``; so has a text in
which nothing is confirmed and no piece matches STEMS; one with such a piece is ``unknown``;
ties go to the more probable piece, then the earlier, then the shorter; repeated rows are
judged row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import cycle, islice

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm.common import shared_path, stored, table

#: What a piece must hold to be classified; searched in lower-cased texts as they are.
MARKS = ("licen", "copyright", "copyleft", "warrant", "spdx", "gpl", "apache", "mozilla", "mpl-", "mpl 2", "mpl v", "mplv2", "mpl2", "bsd", "cc0", "cc by", "cc-by", "commons", "domain", "reserved", "permission", "hereby", "redistribution", "proprietary")
#: What makes a piece a licence statement though its family is not known.
STEMS = r"(?i)licen[cs]e|copyright|copyleft|all rights reserved|creative commons|\bspdx\b|dedicated to the public domain|permission is hereby|redistribution and use"
LONG_LINE = 400
#: Families with the phrases that identify them; every fourth phrase is held out for calibration.
TEMPLATES = {
    "mit": [
        "MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The MIT License (MIT)",
        "License: MIT", "MIT-licensed", "the MIT software license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "license = MIT", "Expat (MIT) license",
    ],
    "apache-2.0": [
        "Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache-2.0 license", "Apache License 2.0",
        "License: Apache 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "Apache Software License", "Apache 2 license", "ASL 2.0 Apache license", "Apache-2.0",
    ],
    "gpl-3.0": [
        "GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0 license", "GPLv3 license",
        "GPLv3", "GNU GPL version 3 or later", "SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0", "GPL version 3", "GPL v3", "GNU GPLv3+",
        "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "gpl-2.0": [
        "GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0 license", "GPLv2 license",
        "GPLv2", "GNU GPL version 2 or later", "SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0", "GPL version 2", "GPL v2", "GNU GPLv2+",
        "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "lgpl": [
        "GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only", "LGPL license", "GNU Lesser General Public License, version 3",
        "LGPLv3", "LGPL-3.0", "LGPLv2.1", "LGPL-2.1", "GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-3.0-or-later", "GNU LGPL", "GNU Library General Public License",
    ],
    "agpl": [
        "GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only", "AGPL license", "GNU Affero General Public License, version 3",
        "AGPLv3", "AGPL-3.0", "GNU AGPL", "SPDX-License-Identifier: AGPL-3.0-or-later", "Affero GPL",
    ],
    "bsd": [
        "BSD License", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD-2-Clause license",
        "BSD 3-Clause", "BSD-style license", "SPDX-License-Identifier: BSD-2-Clause", "3-clause BSD license", "License: BSD", "New BSD license", "Simplified BSD license",
    ],
    "mpl-2.0": [
        "Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "MPL-2.0 license", "Mozilla Public License 2.0",
        "MPL-2.0", "MPL 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "MPLv2", "Mozilla Public License",
    ],
    "isc": [
        "ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "License: ISC",
        "the ISC software license", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "license = ISC", "ISC-licensed",
    ],
    "cc-by": [
        "licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0", "CC BY 3.0",
        "CC-BY", "Creative Commons Attribution License", "CC BY 4.0", "Creative Commons Attribution 3.0 Unported", "License: CC BY",
    ],
    "cc-by-sa": [
        "licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0", "CC BY-SA 3.0",
        "CC-BY-SA", "Creative Commons Attribution Share Alike License", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 3.0 Unported", "License: CC BY-SA",
    ],
    "cc-by-nc": [
        "licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0", "CC BY-NC 3.0",
        "CC-BY-NC", "Creative Commons Attribution Non Commercial License", "CC BY-NC 4.0", "License: CC BY-NC",
    ],
    "cc-by-nc-sa": [
        "licensed under CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "CC BY-NC-SA 3.0",
        "CC-BY-NC-SA", "CC BY-NC-SA 4.0", "License: CC BY-NC-SA",
    ],
    "cc0": [
        "CC0 1.0 Universal license", "dedicated to the public domain under CC0", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Public Domain Dedication",
        "License: CC0", "CC0", "dedicated all copyright and related and neighboring rights to this work to the public domain worldwide", "Creative Commons Zero",
    ],
    "proprietary": [
        "Copyright. All rights reserved", "proprietary license, all rights reserved", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited", "(c) All rights reserved",
        "Copyright by the company. All rights reserved. No part may be reproduced", "proprietary and confidential software",
    ],
}
OPENINGS = ("", "Licensed under the", "Released under the", "This work is licensed under the", "This program is distributed under the terms of the", "The code in this file is available under the", "See the", "Published under", "Distributed under", "is free software under", "All files here are covered by")
ENDINGS = ("", "for details.", "and no other terms.", "by the authors of the project.", "See LICENSE for more.", "or later", "Copyright 2020 the authors.")
#: Sentences with a mark, or with words of a licence, that name no family.
OTHERS = (
    "He lost his driving license on the way to the office.",
    "The new plates need a license from the county.",
    "The state grants a license to sell food and drink.",
    "A license is required to fish in this lake.",
    "Poetic license explains much of the second chapter.",
    "The company may license its patents to third parties.",
    "The warranty covers parts and labour for two years.",
    "There is no warranty on used goods.",
    "Copyright law protects the author of a book.",
    "The court ruled on copyright in music.",
    "The general asked the public for help.",
    "Apache riders crossed the plain without a license.",
    "The MIT laboratory holds a license for the reactor.",
    "Students at MIT need a license to use the lab.",
    "The version of the song is in the public domain.",
    "Please read the license before you go on.",
    "The terms of the license are not known.",
    "This work is licensed under terms that the owner sets.",
    "Released under a license of its own.",
    "The domain of the function is the real line.",
    "She asked for permission to leave the room early.",
    "Permission to land was given by the tower.",
    "Two seats were reserved for the guests of the mayor.",
    "The redistribution of land took ten years.",
    "The house of commons met again on Monday.",
    "I hereby declare the games open.",
    "The Mozilla foundation met in the spring.",
    "The Apache web server runs on port 80.",
    "Er kam mit dem Zug und mit seiner Familie.",
    "The software is free to try for a month.",
    "Free software was the theme of version 2 of the talk.",
    "The sheriff issued a warrant for his arrest.",
    "Its license expired at the end of the year.",
    "License number 2 was given to the driver of bus 3.",
)
UNKNOWN = "unknown"
LEAST_PROBABILITY = 0.5
LEAST_SHARED = 0.7
_models: dict[str, DataFrame] = {}


def grams(text):
    """Distinct word 1- and 2-grams of a text column."""
    words = F.filter(F.split(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), "[^a-z0-9]+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.filter(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(1))), lambda g: F.contains(g, F.lit(" ")))))


def training_rows() -> list[tuple[str, str, bool]]:
    """(piece, family, held out): templates in many settings, with a word left out, and what is no licence.

    Whole phrases are held out, with every setting that they stand in.
    """
    around = cycle(OTHERS)
    rows = [(s, UNKNOWN, k % 4 == 3) for k, s in enumerate(OTHERS) for _ in range(8)]
    rows += [(" ".join(islice(around, 3)), UNKNOWN, k % 4 == 3) for k in range(40)]
    rows += [(f"{opening} license {ending}", UNKNOWN, False) for opening in OPENINGS for ending in ENDINGS]
    for family, phrases in TEMPLATES.items():
        for nth, phrase in enumerate(phrases):
            held = nth % 4 == 3
            for k, opening in enumerate(OPENINGS):
                rows.append((f"{opening} {phrase} {ENDINGS[(k + nth) % len(ENDINGS)]}", family, held))
            rows += [(f"{next(around)} {phrase}. {next(around)}", family, held) for _ in range(4)]
            words = phrase.split()
            if len(words) > 6:
                rows += [(" ".join(words[:i] + words[i + 1 :]), family, held) for i in range(len(words))]
    return rows


def train(spark: SparkSession) -> DataFrame:
    """The model: ``gram, weight`` (one number for each class) and ``share`` (of each template); gram '' has the intercepts.

    Classes and templates are in the order of ``classes()`` and ``templates()``.  The temperature
    is that of a model fitted without the held-out phrases; the model itself is fitted on all.
    """
    names = classes()
    rows = [(text, float(names.index(family)), held) for text, family, held in training_rows()]
    data = spark.createDataFrame(rows, "text string, label double, held boolean").coalesce(1).withColumn("grams", grams(F.col("text")))
    counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0).fit(data)
    seen = counts.transform(data).select("features", "label", "held").cache()
    fitted = LogisticRegression(family="multinomial", regParam=0.001, maxIter=40, standardization=False)
    part = fitted.fit(seen.where("not held"))
    known = [(r["rawPrediction"].toArray(), int(r["label"])) for r in part.transform(seen.where("held")).select("rawPrediction", "label").collect()]
    heat = min((0.25 * 1.25**k for k in range(16)), key=lambda t: sum(_loss(raw / t, label) for raw, label in known))
    model = fitted.fit(seen)
    seen.unpersist()
    weights, bias = model.coefficientMatrix.toArray() / heat, model.interceptVector.toArray() / heat
    shapes = [_shape(p) for _, p in templates()]
    lines = [("", bias.tolist(), [0.0] * len(shapes))]
    for k, gram in enumerate(counts.vocabulary):
        lines.append((gram, weights[:, k].tolist(), [(gram in s) / len(s) for s in shapes]))
    return spark.createDataFrame(lines, "gram string, weight array<double>, share array<double>")


def _shape(phrase: str) -> set[str]:
    """What a piece must share of a template: its n-grams, or only the words of a short one."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in phrase.lower().replace("licence", "license")).split()
    return set(words) if len(words) <= 3 else {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def _loss(raw, label: int) -> float:
    top = float(max(raw))
    return top + math.log(sum(math.exp(float(x) - top) for x in raw)) - float(raw[label])


def model(spark: SparkSession) -> DataFrame:
    """The model of this application, fitted when first asked for."""
    app = spark.sparkContext.applicationId
    if app not in _models:
        _models[app] = stored(train(spark), "license-model", shared_path(spark, "license-model", lasting=True))
    return _models[app]


def save(model: DataFrame, path: str) -> None:
    model.coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def classes() -> list[str]:
    return [*TEMPLATES, UNKNOWN]


def templates() -> list[tuple[str, str]]:
    return [(family, phrase) for family, phrases in TEMPLATES.items() for phrase in phrases]


def _marked(text):
    """Whether a lower-cased text holds a mark."""
    found = F.contains(text, F.lit(MARKS[0]))
    for m in MARKS[1:]:
        found = found | F.contains(text, F.lit(m))
    return found


def pieces(docs: DataFrame) -> DataFrame:
    """``doc_id, row, found``: the marked pieces of every row, each with its first line's number, body and length in lines."""
    text = F.coalesce("text", F.lit(""))
    # Long lines are cut at blanks, twice, the second time half a piece later: what a cut parts is whole in a piece of the other.
    parts = lambda x: F.regexp_extract_all(x, F.lit(r"(?s).{1,%d}(?!\S)|\S+" % LONG_LINE), 0)
    later = lambda x: F.regexp_replace(x, r"(?s)^.{1,%d}(?!\S)" % (LONG_LINE // 2), "")
    cut = F.flatten(F.transform(F.split(text, "\n"), lambda x, i: F.transform(F.when(F.length(x) <= LONG_LINE, F.array(x)).otherwise(F.concat(parts(x), parts(later(x)))), lambda b: F.struct(i.alias("line"), b.alias("body")))))
    from_ = lambda k: F.slice(cut, k, F.greatest(F.size(cut), F.lit(1)))
    four = F.filter(F.arrays_zip(cut.alias("a"), from_(2).alias("b"), from_(3).alias("c"), from_(4).alias("d")), lambda z, i: i % 2 == 0)
    joined = F.transform(four, lambda z: F.struct(z["a"]["line"].alias("line"), F.get(F.split(F.concat_ws("\n", *[z[k]["body"] for k in "abcd"]), r"\n\s*\n"), F.lit(0)).alias("body"), F.lit(4).alias("size")))
    single = F.transform(cut, lambda z: F.struct(z["line"].alias("line"), z["body"].alias("body"), F.lit(1).alias("size")))
    found = F.when(_marked(F.lower(text)), F.filter(F.concat(single, joined), lambda x: _marked(F.lower(x["body"])))).otherwise(F.slice(single, 1, 0))
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), found.alias("found"))


def classify(lines: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``family, probability, similarity, confirmed`` to rows with ``row, line, size, body``."""
    names, shapes = classes(), templates()
    each = lines.select("row", "line", "size", F.col("body").rlike(STEMS).alias("stem"), F.explode(F.concat(F.array(F.lit("")), grams(F.col("body")))).alias("gram"))
    sums = [F.sum(F.col("weight")[k]).alias(f"c{k}") for k in range(len(names))] + [F.sum(F.col("share")[k]).alias(f"s{k}") for k in range(len(shapes))]
    scored = each.join(F.broadcast(model), "gram").groupBy("row", "line", "size").agg(F.max("stem").alias("stem"), *sums)
    raw = F.array(*[F.col(f"c{k}") for k in range(len(names))])
    top = F.array_max(raw)
    best = F.array_position(raw, top).cast("int") - 1
    parts = F.aggregate(raw, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    by_family = F.array(*[F.greatest(*[F.col(f"s{k}") for k, (f, _) in enumerate(shapes) if f == n], F.lit(0.0), F.lit(0.0)) for n in names])
    judged = scored.select("row", "line", "size", "stem", best.alias("best"), (1 / parts).alias("probability"), by_family.alias("near"))
    named = F.element_at(F.array(*map(F.lit, names)), F.col("best") + 1)
    out = judged.withColumns({"family": F.when(F.col("probability") < LEAST_PROBABILITY, F.lit(UNKNOWN)).otherwise(named), "similarity": F.element_at("near", F.col("best") + 1)})
    return out.select("row", "line", "size", "stem", "family", "probability", "similarity", ((F.col("family") != UNKNOWN) & (F.col("similarity") >= LEAST_SHARED - 1e-9)).alias("confirmed"))


def licenses(docs: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """One row for each of ``docs``: its licence, where it stands, and how sure that is."""
    found = stored(pieces(docs), "licenses")
    lines = found.where(F.size("found") > 0).select("row", F.inline("found"))
    judged = classify(lines, fitted if fitted is not None else model(docs.sparkSession))
    best = judged.groupBy("row").agg(
        F.count(F.when(F.col("stem") | F.col("confirmed"), 1)).alias("n_candidates"),
        F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"),
        F.max(F.when(F.col("confirmed"), F.struct("probability", (-F.col("line")).alias("before"), (-F.col("size")).alias("short"), "family", "similarity"))).alias("b"),
    )
    return found.join(best, "row", "left").select(
        "doc_id",
        F.when(F.col("b").isNotNull(), F.col("b.family")).when(F.col("n_candidates") > 0, UNKNOWN).otherwise("none").alias("license"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"),
        (-F.col("b.before")).alias("line"),
        F.col("b.probability").alias("probability"),
        F.col("b.similarity").alias("similarity"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document."""
    return licenses(table(spark, sf_dir, "documents"))
