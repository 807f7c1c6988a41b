"""The license scan on notices that the templates do not hold, and its scores restated."""

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from hydrospark.llm import licenses as L
from hydrospark.llm.common import shared_path

#: (family, notice); None: no licence of a known family.  Seen while the operator was written.
SEEN = [
    ("mit", "# SPDX-License-Identifier: MIT"), ("mit", "License: MIT"), ("mit", "This library is distributed under the terms of the MIT license."), ("mit", "Licence: MIT"),
    ("mit", "Copyright (c) 2014 Jane Roe. Use of this source code is governed by the MIT license that can be found in the LICENSE file."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction'),
    ("apache-2.0", "// Licensed to the authors under one or more agreements.\n// See the Apache License, Version 2.0."), ("apache-2.0", "project license: Apache-2.0"), ("apache-2.0", "Available under Apache-2.0."),
    ("gpl-3.0", "Distributed under the GPLv3."), ("gpl-3.0", "Released under GPL-3.0."), ("gpl-3.0", "GNU GPL version 3 or later"), ("gpl-3.0", "Licensed under GPLv3"),
    ("gpl-3.0", "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version."),
    ("gpl-2.0", "GNU GPL, version 2"), ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0"), ("gpl-2.0", "The kernel module is GPLv2."),
    ("lgpl", "This library is free software under the LGPL-2.1."), ("lgpl", "you can redistribute it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation"), ("lgpl", "Linked as LGPLv3 code"),
    ("agpl", "The server is licensed under the AGPLv3."), ("bsd", "SPDX-License-Identifier: BSD-3-Clause"), ("bsd", "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file."),
    ("mpl-2.0", "free software under the MPL-2.0"), ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this"),
    ("isc", "SPDX-License-Identifier: ISC"), ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above"),
    ("cc-by", "Figures: CC BY 4.0"), ("cc-by-sa", "Content on this site is CC BY-SA 4.0 unless noted."), ("cc-by-nc", "You can reuse the photos under CC BY-NC 4.0"), ("cc-by-nc-sa", "The course is offered under a CC BY-NC-SA 4.0 licence"), ("cc0", "Data released into the public domain under CC0."),
    ("proprietary", "Copyright 2021 Acme Ltd. All rights reserved."), ("proprietary", "Proprietary and confidential. Unauthorized copying is prohibited."),
    (None, "The dog license must be renewed each year."), (None, "All copyright questions go to the legal team."), (None, "Apache helicopters flew over the city."), (None, "The professor left MIT with a licence to teach."), (None, "Wir fahren mit der Bahn, mit Lizenz."), (None, "This is licensed under a custom agreement with the vendor."),
]
#: Written when the templates and the model were done, and never used to change them.
FRESH = [
    ("mit", "The source of this tool is open, under MIT license terms."), ("mit", "setup(name='x', license='MIT')"), ("mit", "Dual licensed; pick the MIT License if you can."), ("mit", "Code: MIT License. Docs: see website."), ("mit", "[![License: MIT](badge.svg)](LICENSE)"),
    ("apache-2.0", "Kubernetes manifests are shared under the Apache License, Version 2.0."), ("apache-2.0", '"license": "Apache-2.0"'), ("apache-2.0", "## License\nApache License, Version 2.0, January 2004"), ("apache-2.0", "Copyright 2019 The Team. SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", " * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *    the Apache License, Version 2.0"),
    ("gpl-3.0", "This tool comes with the GNU General Public License, version 3."), ("gpl-3.0", "license = GPL-3.0-or-later"), ("gpl-3.0", "either version 3 of the GNU General Public License, or any later version"), ("gpl-3.0", "My fork stays GPLv3."), ("gpl-3.0", "terms of the GNU GPL v3"),
    ("gpl-2.0", "Linux is distributed under GPL version 2."), ("gpl-2.0", "GPL-2.0-only"), ("gpl-2.0", "under the terms of the GNU General Public License version 2 only,\nas published by the Free Software Foundation."), ("gpl-2.0", "License: GPL v2"),
    ("lgpl", "The codec library is LGPL-2.1 licensed."), ("lgpl", "GNU Lesser General Public License v3"), ("lgpl", "This file is covered by the LGPL, see COPYING.LESSER"),
    ("agpl", "Network use is covered by the GNU Affero General Public License v3."), ("agpl", "SPDX-License-Identifier: AGPL-3.0-or-later"), ("agpl", "Our backend is AGPL-3.0."),
    ("bsd", "This module uses the 3-clause BSD license."), ("bsd", "license: BSD-3-Clause"), ("bsd", "released under a BSD license, see COPYING"), ("bsd", " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted."),
    ("mpl-2.0", "The browser engine is under the Mozilla Public License."), ("mpl-2.0", "License: MPL 2.0"), ("mpl-2.0", "Files carry the MPL-2.0 header."),
    ("isc", "npm packages by this author use the ISC license."), ("isc", '"license": "ISC"'),
    ("cc-by", "The paper is published under a CC BY 4.0 license."), ("cc-by", "Creative Commons Attribution 4.0"), ("cc-by-sa", "Wikipedia text is CC BY-SA 3.0."), ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 applies to all articles"), ("cc-by-nc", "Slides: CC-BY-NC-4.0"), ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0"), ("cc-by-nc-sa", "open courseware, CC BY-NC-SA 4.0"),
    ("cc0", "The map data is CC0 1.0."), ("cc0", "CC0 1.0 Universal (Public Domain Dedication)"), ("proprietary", "(c) 2011 Big Corp. All rights reserved."), ("proprietary", "This file is proprietary and confidential software of the vendor."),
    (None, "He was granted a pilot license in May."), (None, "The license plate was found in the ditch."), (None, "No license was needed for the small boat."), (None, "The copyright term was raised to seventy years."), (None, "An apache chief spoke to the general."), (None, "The common domain of both functions is closed."), (None, "With the permission of the owner we walked on."),
    (None, "Hereby ends the second version of the tale."), (None, "The BSD conference took place in Ottawa."), (None, "Mozilla published a blog post on privacy."), (None, "MIT and Stanford signed a treaty on public data."), (None, "General public interest in the 3 versions was low."), (None, "The dealer gave a two year warranty and a licence to resell."), (None, "Creative people share the commons."), (None, "This content is licensed to the named subscriber only."),
]
BEFORE, AFTER = "The valley was quiet and the river low that year.", "Nobody came by for weeks, said the old man."


def answers(spark, notices):
    docs = spark.createDataFrame([(i, f"{BEFORE}\n{t}\n{AFTER}") for i, (_, t) in enumerate(notices)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in L.licenses(docs).collect()}
    return [None if got[i] in ("none", "unknown") else got[i] for i in range(len(notices))]


def rates(notices, found):
    right = sum(f is not None and f == g for (f, _), g in zip(notices, found))
    return right / sum(g is not None for g in found), right / sum(f is not None for f, _ in notices)


def test_notices(spark):
    for notices in (SEEN, FRESH):
        found = answers(spark, notices)
        precision, recall = rates(notices, found)
        wrong = [(f, g, t) for (f, t), g in zip(notices, found) if f != g]
        print(f"{len(notices)} notices: precision {precision:.3f}, recall {recall:.3f}", wrong)
        assert precision >= 0.9 and recall >= 0.9, wrong


def test_every_phrase_is_marked():
    """What the model is trained for reaches it."""
    assert [p for _, p in L.templates() if not any(m in p.lower() for m in L.MARKS)] == []


def plain_grams(text):
    w = re.findall("[a-z0-9]+", text.lower().replace("licence", "license"))
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


def test_scores_restated(spark):
    """Probability, similarity and verdict of pieces from the stored model, by numpy."""
    table = {r.gram: (np.array(r.weight), np.array(r.share)) for r in L.model(spark).collect()}
    texts = [t.replace("\n", " ") for _, t in SEEN + FRESH]
    lines = spark.createDataFrame([(i, 0, 1, t) for i, t in enumerate(texts)], "row long, line int, size int, body string")
    family = [f for f, _ in L.templates()]
    for r in L.classify(lines, L.model(spark)).collect():
        raw = table[""][0].copy()
        share = defaultdict(float)
        for g in plain_grams(texts[r.row]) & table.keys():
            raw += table[g][0]
        total = sum((table[g][1] for g in plain_grams(texts[r.row]) & table.keys()), np.zeros(len(family)))
        for f, s in zip(family, total):
            share[f] = max(share[f], s)
        p = np.exp(raw - raw.max())
        k = int(p.argmax())
        name = L.classes()[k]
        assert abs(r.probability - p[k] / p.sum()) < 1e-9 and abs(r.similarity - share[name]) < 1e-9
        assert r.family == (name if p[k] / p.sum() >= L.LEAST_PROBABILITY else L.UNKNOWN)
        assert r.confirmed == (r.family != L.UNKNOWN and share[name] >= L.LEAST_SHARED - 1e-9)


def test_calibration_on_phrases_never_seen(spark):
    """Over the fresh notices the mean probability of the chosen class is near the share of right choices."""
    lines = spark.createDataFrame([(i, 0, 1, t) for i, (_, t) in enumerate(FRESH)], "row long, line int, size int, body string")
    got = {r.row: r for r in L.classify(lines, L.model(spark)).collect()}
    sure = [got[i].probability for i in range(len(FRESH))]
    right = [got[i].family == (f or L.UNKNOWN) for i, (f, _) in enumerate(FRESH)]
    assert abs(np.mean(sure) - np.mean(right)) < 0.15


def plain_cuts(line):
    """Pieces of a long line that end with a word, and those of the line without its first half piece."""

    def end(x, a, size):
        fit = [e for e in range(a + 1, min(a + size, len(x)) + 1) if e == len(x) or x[e] == " "]
        return fit[-1] if fit else None

    def parts(x):
        out, a = [], 0
        while a < len(x):
            e = end(x, a, L.LONG_LINE)
            if e is None and x[a] != " ":
                e = (x + " ").index(" ", a)
            if e:
                out.append(x[a:e])
            a = e or a + 1
        return out

    return parts(line) + parts(line[end(line, 0, L.LONG_LINE // 2) or 0 :]) if len(line) > L.LONG_LINE else [line]


def plain_pieces(text):
    cut = [(i, b) for i, x in enumerate((text or "").split("\n")) for b in plain_cuts(x)]
    out = [(i, b, 1) for i, b in cut]
    for k in range(0, len(cut), 2):
        joined = "\n".join(b for _, b in cut[k : k + 4])
        out.append((cut[k][0], re.split(r"\n\s*\n", joined)[0], 4))
    return sorted(x for x in out if any(m in x[1].lower() for m in L.MARKS))


def test_pieces_restated(spark):
    long = "word " * 300 + "MIT License " + "word " * 300
    texts = [None, "", "MIT License", long, f"a\n\nGNU General\nPublic License,\nversion 3\n\nb\n{long}\nend license", "x" * 5000 + "license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sorted((p.line, p.body, p.size) for p in r.found) for r in L.pieces(docs).collect()}
    assert got == {i: plain_pieces(t) for i, t in enumerate(texts)}


def test_a_saved_model_gives_the_same(spark):
    path = shared_path(spark, "license-model")
    L.save(L.model(spark), path)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(FRESH)], "doc_id long, text string")
    key = lambda r: r.doc_id
    assert sorted(L.licenses(docs, L.load(spark, path)).collect(), key=key) == sorted(L.licenses(docs).collect(), key=key)


def test_a_line_in_every_document_is_no_group(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("Released under the MIT License.").alias("text"))
    assert L.licenses(docs).where("license = 'mit'").count() == 500


def test_a_statement_anywhere_in_a_long_line(spark):
    """Cuts of long lines fall between words, and what one cut parts the other keeps."""
    word, said = "lorem", "SPDX-License-Identifier: MIT"
    rows = [(k, ((word + " ") * 200)[: k - 1] + " " + said + " " + (word + " ") * 120) for k in [*range(180, 212), *range(375, 405), *range(590, 610), *range(790, 806)]] + [(2000, "x" * 900 + " " + said), (2001, said + " " + "y" * 900)]
    got = {r.doc_id: r.license for r in L.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, x in got.items() if x != "mit"} == set()
