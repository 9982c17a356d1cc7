"""Operator 6, license scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory. DataFrame functions only.

Each line, each paragraph (lines between blank ones) and the text as a whole is a possible notice: headers are lines or paragraphs, licence files
paragraphs or whole texts. Its vector has a weight for each distinct word, the word's inverse document frequency over
the whole table; equal notices are one. The templates' words are a fixed small vocabulary, so the inverted lists (word, template, weight)
are small. A cosine is at most the root of the share of the template's squared weights that
the notice holds; of each template, the lightest words that together stay under the share needed cannot make a match alone, so only
texts, and then notices, with one of the other words (however common it is) go on to
the join of their words with these lists, whose grouped sums are the dot products. Notices that would reach the threshold if they had no
further words then get the weights of these: those of common words by broadcast (at most ``COMMON`` times the mean number of distinct
words of a text), those of the others by shuffle.
Header tags (``SPDX-License-Identifier``) are templates as well, of which a notice must hold every word: tags of different licenses are near to each other.
A text's own license is that of the best template with a cosine of at least ``THRESHOLD`` over its notices.

A licence file (given by a condition) lends its license to its directory. Directories, not files, look for the nearest
ancestor with a license: each distinct directory is joined by path with its own prefixes. Files get their directory's answer by
broadcast where the directories are few (``BROADCAST_DIRECTORIES``), else by a join salted ``SALTS`` ways, as one directory may hold most files.

Nulls: a null text has no lines; a null path has no directory. Ties go to the smaller license name, then the smaller path.
Repeated rows are each answered. An empty table gives no rows. Columns other than id, path and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, tidy_shuffles

THRESHOLD = 0.6
#: A word that more than one text in so many has is common.
COMMON = 1000
#: Common words are broadcast up to this number; beyond it all words' weights come by shuffle.
BROADCAST_WORDS = 1 << 20
BROADCAST_DIRECTORIES, SALTS = 100_000, 16
#: Common licence notices and the opening parts of licence texts, by their customary names.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Artistic-2.0", "This program is free software; you may redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
        "License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
        "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software.",
    ),
]
#: Identifiers that a header tag may name.
TAGGED = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 "
    "CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only "
    "LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 WTFPL Zlib"
).split()
TAG = "SPDX-License-Identifier: "
#: The templates with whether a notice must hold all of a template's words: a tag that names another license is near to each of these.
ALL_TEMPLATES = [(name, text, False) for name, text in TEMPLATES] + [(name, TAG + name, True) for name in TAGGED]


def _split(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z0-9]+")


def _notices(text: Column) -> Column:
    """Lines, paragraphs and the text, each once."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[\s/#*;-]*\n"), F.array(text)))


def _words(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_remove(F.array_distinct(_split(text)), "")


def _bearing(weights: dict[str, float], templates: list[tuple[list[str], bool]]) -> list[str]:
    """Words of which any line within ``THRESHOLD`` of a template has at least one, whatever else it holds. Of a template that is needed whole, one is enough."""
    found = set()
    for words, whole in templates:
        if whole:
            found.add(max(words, key=lambda w: (weights[w], w)))
            continue
        rest = (THRESHOLD**2 - 1e-9) * sum(weights[w] ** 2 for w in words)
        for w in sorted(words, key=lambda w: (weights[w], w)):
            rest -= weights[w] ** 2
            if rest <= 0:
                found.add(w)
    return sorted(found)


def _lists(counts: DataFrame, total: int) -> tuple[DataFrame, dict[str, float], list[str]]:
    """The inverted lists, the vocabulary's weights and its bearing words."""
    spark = counts.sparkSession
    templates = spark.createDataFrame([(i, *t) for i, t in enumerate(ALL_TEMPLATES)], "template int, license string, body string, whole boolean")
    needed = F.when(F.col("whole"), F.size(_words(F.col("body")))).otherwise(0).alias("needed")
    listed = templates.select("template", "license", needed, F.explode(_words(F.col("body"))).alias("word"))
    rows = listed.groupBy("template", "needed").agg(F.collect_list("word").alias("words")).collect()  # the templates' words only
    vocabulary = sorted({w for r in rows for w in r.words})
    weights = dict.fromkeys(vocabulary, math.log(1.0 + total))
    weights |= {r.word: math.log((1.0 + total) / r.n) for r in counts.filter(F.col("word").isin(vocabulary)).collect()}  # a row per vocabulary word
    weighed = spark.createDataFrame(list(weights.items()), "word string, weight double")
    lists = listed.join(F.broadcast(weighed), "word")
    norms = lists.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    return cut(lists.join(norms, "template")), weights, _bearing(weights, [(r.words, r.needed > 0) for r in rows])


def own_licenses(files: DataFrame) -> DataFrame:
    """``key, license, score`` for each text (``key, text``) with a header."""
    total = files.count()
    counts = cut(files.select(F.explode(_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    lists, weights, bearing = _lists(counts, total)
    vocabulary = F.array(*map(F.lit, sorted(weights)))
    squares = F.create_map(*[F.lit(x) for w, weight in weights.items() for x in (w, weight**2)])
    needed = F.array(*map(F.lit, bearing))
    # Texts without a bearing word end here; only the others are cut into notices.
    likely = files.filter(F.arrays_overlap(_split(F.col("text")), needed))
    notices = likely.select("key", F.explode(_notices(F.col("text"))).alias("body")).filter(F.arrays_overlap(_split(F.col("body")), needed))
    words = notices.select("key", F.sort_array(_words(F.col("body"))).alias("words"))
    held = cut(words.select("key", F.sha2(F.array_join("words", " "), 256).alias("line"), "words", F.array_intersect("words", vocabulary).alias("held")))
    # Each distinct notice's parts of its squared length: of the vocabulary's words, and of the others.
    distinct = held.groupBy("line").agg(F.first("words").alias("words"), F.first("held").alias("held"))
    distinct = distinct.withColumn("own", F.aggregate("held", F.lit(0.0), lambda x, w: x + F.try_element_at(squares, w)))
    spread = distinct.select("line", "own", F.explode("held").alias("word"))
    dots = spread.join(F.broadcast(lists), "word").groupBy("line", "own", "template", "license", "norm", "needed").agg(F.sum(F.col("weight") ** 2).alias("dot"), F.count("*").alias("shared"))
    cosine = lambda other: F.col("dot") / (F.col("norm") * F.sqrt(F.col("own") + other))
    dots = cut(dots.filter((F.col("shared") >= F.col("needed")) & (cosine(F.lit(0.0)) >= THRESHOLD - 1e-9)))
    rest = distinct.join(dots.select("line").distinct(), "line", "left_semi").select("line", F.explode(F.array_except("words", vocabulary)).alias("word"))
    rest = cut(rest)
    square = F.log((1.0 + total) / F.col("n")) ** 2
    often = F.col("n") > total / COMMON
    if counts.filter(often).count() > BROADCAST_WORDS:
        often = F.lit(False)
    marked = rest.join(F.broadcast(counts.filter(often).select("word", square.alias("square"))), "word", "left")
    seldom = marked.filter("square is null").select("line", "word").join(counts.filter(~often).select("word", square.alias("square")), "word")
    others = marked.filter("square is not null").select("line", "square").union(seldom.select("line", "square")).groupBy("line").agg(F.sum("square").alias("others"))
    scored = dots.join(others, "line", "left").select("line", "license", cosine(F.coalesce("others", F.lit(0.0))).alias("score"))
    best = scored.filter(F.col("score") >= THRESHOLD - 1e-12).groupBy("line").agg(F.min(F.struct((-F.round("score", 9)).alias("less"), "license")).alias("best"))
    best = held.select("line", "key").join(cut(best), "line").groupBy("key").agg(F.min("best").alias("best"))
    return best.select("key", "best.license", (-F.col("best.less")).alias("score"))


def scan(files: DataFrame, licence_file: Column, *, id_column: str = "doc_id", path_column: str = "path", text_column: str = "text") -> DataFrame:
    """``doc_id, path, license, score, origin, directory``; ``origin``: ``own``, ``inherited`` or null.

    ``licence_file`` is a condition over ``path`` and ``text``; only files with a license of their own lend it.
    """
    rows = files.select(F.col(id_column).cast("long").alias("doc_id"), F.col(path_column).cast("string").alias("path"), F.col(text_column).cast("string").alias("text"))
    key = F.xxhash64("doc_id", "path", "text").alias("key")
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
    with tidy_shuffles(files.sparkSession):
        # Rows with equal id, path and text have equal answers.
        own = own_licenses(rows.select(key, "text"))
        # From here on only names are needed.
        names = cut(rows.select(key, "doc_id", "path", F.coalesce(licence_file, F.lit(False)).alias("lends")))
        known = cut(names.join(own, "key", "left"))
    lent = known.filter(F.col("license").isNotNull() & F.col("lends")).withColumn("directory", directory).filter("directory is not null")
    lent = lent.groupBy("directory").agg(F.min(F.struct((-F.col("score")).alias("less"), "license", "path")).alias("best"))
    lent = lent.select(F.col("directory").alias("ancestor"), F.col("best.license").alias("lent"), (-F.col("best.less")).alias("lent_score"))
    places = cut(known.select(directory.alias("directory")).filter("directory is not null").distinct())
    depth = F.size(F.split("directory", "/"))
    prefixes = places.select("directory", F.explode(F.sequence(F.lit(1), depth)).alias("depth"))
    prefixes = prefixes.select("directory", "depth", F.array_join(F.slice(F.split("directory", "/"), 1, F.col("depth")), "/").alias("ancestor"))
    nearest = prefixes.join(lent, "ancestor").groupBy("directory").agg(F.max_by(F.struct("ancestor", "lent", "lent_score"), "depth").alias("near"))
    placed = known.withColumn("directory", directory)
    if places.count() <= BROADCAST_DIRECTORIES:
        answers = placed.join(F.broadcast(nearest), "directory", "left")
    else:
        dealt = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        answers = placed.withColumn("salt", F.pmod(F.xxhash64("key", "doc_id", "path"), F.lit(SALTS)).cast("int")).join(dealt, ["directory", "salt"], "left")
    inherited = F.col("license").isNull() & F.col("near").isNotNull()
    return answers.select(
        "doc_id",
        "path",
        F.coalesce("license", "near.lent").alias("license"),
        F.coalesce("score", "near.lent_score").alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(inherited, "inherited").alias("origin"),
        F.when(inherited, F.col("near.ancestor")).alias("directory"),
    )
