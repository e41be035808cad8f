"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermark.llm.common import WORD, checkpoint

# Titles, notices, headers and bodies by which public licences are named or stated in files.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Available under the terms of the MIT license, see LICENSE for details.",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "ISC": ("ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "GPL": ("GNU GENERAL PUBLIC LICENSE", "Licensed under the GNU General Public License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.0": (
        "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "MIT OR Apache-2.0": (
        "Dual licensed under MIT or Apache-2.0.",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
    ),
    "EPL-1.0": ("Eclipse Public License - v 1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    "EPL-2.0": ("Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "BSL-1.0": ("Boost Software License - Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Released to the public domain under CC0 1.0 Universal.", "Creative Commons CC0 1.0 Universal public domain dedication"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
        "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. The copyright holder",
    ),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Parts of a text that may be compared; every template has one of these words.
NOTICE = r"(?i)licen[sc]e|public domain|redistribut|copyright|permission|\bMPL\b"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: What stands before the text of a comment's line, and between sentences.
MARKS, SENTENCE = r"(?m)^[\x20\t]*(?://+|#+|/\*+|\*+/?|--+|;+|%+|<!--)[\x20\t]?", r"(?<=[.;])\s+(?=[A-Z(])"
#: Cosine that a part must reach, and the share of a file's words in such parts that makes it a licence file.
LEAST, SHARE = 0.7, 0.2


def listed(templates: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """License and text of each template; each license also has its identifier's line."""
    return [(k, t) for k, ts in sorted(templates.items()) for t in [*ts, f"SPDX-License-Identifier: {k}"]]


def template_weights(texts: Sequence[str]) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Each term's inverse document frequency among the templates, and their unit vectors."""
    terms = [Counter(re.findall(TERM, t.lower())) for t in texts]
    df = Counter(t for c in terms for t in c)
    idf = {t: math.log((1 + len(terms)) / (1 + n)) + 1 for t, n in df.items()}
    made = []
    for c in terms:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        made.append({t: n * idf[t] / norm for t, n in c.items()})
    return idf, made


def parts(text: Column) -> Column:
    """array<struct<paragraph, part>>: what may be notices of a text: paragraphs, their lines and their sentences.

    Comment marks at the beginnings of lines do not count. Paragraphs are parted by
    empty lines, so a header over several lines is one.
    """
    plain = F.regexp_replace(text, MARKS, "")
    some = F.filter(F.transform(F.split(plain, r"\n[\x20\t\r]*\n"), lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: x["p"].rlike(NOTICE))
    each = lambda p: F.array_distinct(F.concat(F.array(p), F.split(p, "\n"), F.split(p, SENTENCE)))
    return F.flatten(F.transform(some, lambda x: F.transform(F.filter(each(x["p"]), lambda q: q.rlike(NOTICE)), lambda q: F.struct(x["i"].alias("paragraph"), q.alias("part")))))


def notices(files: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """key, license, score, words and opens for each text with a notice: its best license.

    files: key, text; texts of the same key are the same. Parts of a text are compared
    with the templates by the cosine of sparse TF-IDF vectors; each paragraph counts for a
    license with its most alike part, if that reaches least. Terms that no template has
    weigh as rare ones do, so other words in a part count against it. The license with
    the most words in such parts is the best; ties go to the better score, then the name.
    Versions are templates of their own, as a header of one is nearly that of the next; a
    choice of licenses ("MIT OR Apache-2.0") is one, too. score: its best part's; opens: one of its parts is in the first paragraph. The
    templates' terms are a table of fixed size, which is sent to all tasks.
    """
    spark = files.sparkSession
    every = listed(templates)
    idf, vectors = template_weights([t for _, t in every])
    rare = math.log(1 + len(every)) + 1
    known = spark.createDataFrame([(t, idf[t], [(i, v[t]) for i, v in enumerate(vectors) if t in v]) for t in sorted(idf)], "term string, idf double, of array<struct<template:int,w:double>>")
    names = F.array(*[F.lit(k) for k, _ in every])
    found = files.where(F.col("text").rlike(NOTICE)).select("key", F.explode(parts(F.col("text"))).alias("x")).select("key", "x.paragraph", "x.part")
    size = F.size(F.regexp_extract_all("part", F.lit(WORD), F.lit(0)))
    # measured once for a part, before its terms become rows
    measured = found.select("key", "paragraph", F.xxhash64("part").alias("at"), size.alias("words"), F.regexp_extract_all(F.lower("part"), F.lit(TERM), F.lit(0)).alias("terms"))
    terms = measured.select("key", "paragraph", "at", "words", F.explode("terms").alias("term"))
    # a text that is there more than once has the same parts in each of its rows
    counts = terms.groupBy("key", "paragraph", "at", "words", "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.join(F.broadcast(known), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(rare)))
    at = ["key", "paragraph", "at", "words"]
    norms = weighed.groupBy(*at).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("of").isNotNull(), F.struct("w", "of"))).alias("found"))
    dots = norms.select(*at, "norm", F.explode("found").alias("f")).select(*at, "norm", "f.w", F.explode("f.of").alias("t"))
    scores = dots.groupBy(*at, "norm", F.col("t.template").alias("template")).agg(F.sum(F.col("w") * F.col("t.w")).alias("dot"))
    good = scores.select(*at, F.element_at(names, F.col("template") + 1).alias("license"), F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= least)
    best = good.groupBy("key", "paragraph", "license").agg(F.max(F.struct("score", "words")).alias("x"))
    whole = best.groupBy("key", "license").agg(F.max("x.score").alias("score"), F.sum("x.words").alias("words"), F.bool_or(F.col("paragraph") == 0).alias("opens"))
    top = F.min_by(F.struct("license", "score", "words", "opens"), F.struct(-F.col("words"), -F.col("score"), "license"))
    return whole.groupBy("key").agg(top.alias("x")).select("key", "x.*")


def licensed(files: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, least: float = LEAST, share: float = SHARE) -> DataFrame:
    """For each row of files: file_id, path, license, score, own and from_dir.

    files: file_id, path ("/"-separated), text; other columns do not matter. A file's own
    notice, if it has one, holds (own, with its score). Otherwise it takes the license of
    the nearest directory above it, itself included, that has a licence file: one whose
    notices have at least share of its words, or one named LICENSE, LICENCE or COPYING
    that a notice or title opens. Of several there, the best score decides, then the name.
    license is null if there is none. A null or empty text has no notice; a null path is
    in no directory. Ids may be null or repeated: a row's own notice is that of its text.
    An empty table gives an empty one. Texts are read whole. Directories, not files, are
    joined with those above them.
    """
    size = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    folder = F.regexp_replace(F.regexp_extract(F.concat(F.lit("/"), F.col("path")), r"^(.*)/[^/]*$", 1), r"^/+", "/")
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    plain = files.select("file_id", "path", F.col("text").cast("string").alias("text")).select("file_id", "path", "text", folder.alias("dir"), key.alias("key"))
    own = checkpoint(notices(plain.select("key", "text"), templates, least))
    # only texts with a notice are measured
    mine = plain.where(F.col("text").rlike(NOTICE)).join(own, "key")
    named_so = F.regexp_extract("path", r"([^/]*)$", 1).rlike(r"(?i)^(licen[sc]e|copying)")
    full = mine.where(F.col("dir").isNotNull() & ((F.col("words") >= share * size) | F.col("opens") & named_so))
    named = full.groupBy("dir").agg(F.min_by("license", F.struct(-F.col("score"), "license")).alias("of"))
    dirs = plain.where("dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("up"))))
    up = dirs.select("dir", above.alias("a")).select("dir", "a.depth", F.col("a.up").alias("up"))
    near = up.join(named.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "of"), "depth").alias("x")).select(F.col("dir").alias("_dir"), F.col("x.up").alias("from_dir"), F.col("x.of").alias("inherited"))
    rows = plain.select("file_id", "path", "dir", "key").join(own.select("key", F.col("license").alias("mine"), "score"), "key", "left")
    rows = rows.join(near, F.col("dir") == F.col("_dir"), "left")
    has = F.col("mine").isNotNull()
    return rows.select("file_id", "path", F.coalesce("mine", "inherited").alias("license"), "score", has.alias("own"), F.when(~has, F.col("from_dir")).alias("from_dir"))


def op6(spark, sf_dir: str) -> DataFrame:
    """Documents as files: source/lang/block of a thousand ids/id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.expr("doc_id div 1000").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return licensed(files).select(F.col("file_id").alias("doc_id"), "path", "license", "score", "own", "from_dir")
