import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tiermark.llm.licenses import LEAST, MARKS, NOTICE, SENTENCE, SHARE, TEMPLATES, TERM, licensed, listed, notices, op6

EVERY = listed(TEMPLATES)
TERMS = [Counter(re.findall(TERM, t.lower())) for _, t in EVERY]
DF = Counter(t for c in TERMS for t in c)


def norm(c):
    return math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()))


def idf(t):
    return math.log((1 + len(TERMS)) / (1 + DF[t])) + 1


def cosines(part):
    a = Counter(re.findall(TERM, part.lower()))
    return [(k, round(sum(n * b[t] * idf(t) ** 2 for t, n in a.items()) / (norm(a) * norm(b)), 9)) for (k, _), b in zip(EVERY, TERMS, strict=True)] if a else []


def count(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t))


def notice(text):
    """license, score, words, opens by the rule, part by part."""
    sums = {}
    for i, p in enumerate(re.split(r"\n[ \t\r]*\n", re.sub(MARKS, "", text or ""))):
        best = {}
        for q in {p, *p.split("\n"), *re.split(SENTENCE, p)} if re.search(NOTICE, p) else ():
            for k, x in cosines(q) if re.search(NOTICE, q) else ():
                if x >= LEAST:
                    best[k] = max(best.get(k, (0, 0)), (x, count(q)))
        for k, (x, n) in best.items():
            score, words, opens = sums.get(k, (0, 0, False))
            sums[k] = max(score, x), words + n, opens or i == 0
    if not sums:
        return None
    k = min(sums, key=lambda k: (-sums[k][1], -sums[k][0], k))
    return k, *sums[k]


def brute(files):
    own, named, dirs = {}, {}, {}
    for i, path, text in files:
        found = own[i] = notice(text)
        d = dirs[i] = None if path is None else re.sub("^/+", "/", "/" + path).rpartition("/")[0]
        if found and d is not None and (found[2] >= SHARE * count(text) or found[3] and re.match("(?i)licen[sc]e|copying", path.rpartition("/")[2])):
            named.setdefault(d, []).append((-found[1], found[0]))
    made = {}
    for i, _, _ in files:
        d, got = dirs[i], None
        while d is not None and not own[i]:
            if d in named:
                got = min(named[d])[1], d
                break
            d = d.rpartition("/")[0] if d else None
        made[i] = (own[i][0], own[i][1], True, None) if own[i] else (got[0], None, False, got[1]) if got else (None, None, False, None)
    return made


def got(rows, key):
    return {r[key]: (r["license"], None if r["score"] is None else round(r["score"], 9), r["own"], r["from_dir"]) for r in rows}


def test_every_template_finds_itself():
    for k, t in EVERY:
        assert re.search(NOTICE, t) and max(cosines(t), key=lambda x: x[1]) == (k, 1.0)


def test_query(spark, documents):
    docs = documents.collect()
    files = [(r["doc_id"], f"{r['source']}/{r['lang']}/{r['doc_id'] // 1000}/{r['doc_id']}.txt", r["text"]) for r in docs]
    assert got(op6(spark, "/root/testdata/sf0.001").collect(), "doc_id") == brute(files)


MIT = "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + "\n\n".join(TEMPLATES["MIT"][2:]) + "\n"
BSD = "BSD 3-Clause License\n\nCopyright (c) 2019, Some Body\nAll rights reserved.\n\n" + TEMPLATES["BSD-3-Clause"][2].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ")
GPL = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n"
KNOWN = [
    ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), (TEMPLATES["MIT"][2], "MIT"), ("/*\n" + GPL + " */\nint main;", "GPL-3.0"), ("GNU GENERAL PUBLIC LICENSE", "GPL"),
    ("BSD 3-Clause License", "BSD-3-Clause"), (TEMPLATES["BSD-3-Clause"][2], "BSD-3-Clause"), ("Creative Commons Attribution 4.0 International License", "CC-BY-4.0"), ("Copyright 2020 Jane Q. Doe. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    (MIT, "MIT"), (BSD, "BSD-3-Clause"), ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n" + "other words of it " * 900, "GPL-2.0"), ("no notice in a text about a driving licence test", None), ("", None), (None, None),
]


def test_known_headers_and_files(spark):
    rows = notices(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(KNOWN)], "key int, text string")).collect()
    assert {r["key"]: r["license"] for r in rows} == {i: k for i, (_, k) in enumerate(KNOWN) if k}
    assert {r["key"]: (r["license"], round(r["score"], 9), r["words"], r["opens"]) for r in rows} == {i: notice(t) for i, (t, k) in enumerate(KNOWN) if k}


def test_inheritance(spark):
    mit, apache = TEMPLATES["MIT"][0], TEMPLATES["Apache-2.0"][0]
    files = [(1, "LICENSE", MIT), (2, "a/x.c", "code"), (3, "a/b/LICENSE", apache), (4, "a/b/c/d.c", "code"), (5, "a/b/own.c", f"{mit}\n" + "code " * 200), (6, "z.c", None), (7, None, "x"), (8, "/q/r.c", ""), (9, "a/b/LICENSE2", mit), (10, "g/COPYING", KNOWN[11][0]), (11, "g/x.c", "code")]
    df = spark.createDataFrame([(*f, "clash") for f in files], "file_id long, path string, text string, license string")
    rows = licensed(df).collect()
    assert got(rows, "file_id") == brute(files)
    assert {r["file_id"]: r["license"] for r in rows} == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "Apache-2.0", 5: "MIT", 6: "MIT", 7: None, 8: "MIT", 9: "MIT", 10: "GPL-2.0", 11: "GPL-2.0"}
    assert licensed(df.where("false")).collect() == []


@pytest.mark.parametrize("long", [1, 60_000])
def test_null_and_repeated_ids_and_long_texts(spark, long):
    """Two texts of one id, and rows without one, each have their own notice."""
    mit, apache = TEMPLATES["MIT"][0], TEMPLATES["Apache-2.0"][0]
    rows = [(1, "a/x", f"{mit}\n\n" + "word " * long), (1, "b/y", apache), (None, "c/z", mit), (None, "d/w", "nothing"), (1, "b/y", apache)]
    made = licensed(spark.createDataFrame(rows, "file_id long, path string, text string")).select("path", "license", F.col("own")).collect()
    assert sorted(map(tuple, made)) == [("a/x", "MIT", True), ("b/y", "Apache-2.0", True), ("b/y", "Apache-2.0", True), ("c/z", "MIT", True), ("d/w", None, False)]


def test_versions_choices_and_short_forms(spark):
    """Lines of the kinds that were read as another version, or not at all."""
    lines = {
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": "LGPL-2.1",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "LGPL-3.0",
        "Dual licensed under MIT or Apache-2.0": "MIT OR Apache-2.0",
        "This project is available under the terms of the MIT license, see LICENSE for details": "MIT",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "BSD-3-Clause",
        "Eclipse Public License - v 2.0": "EPL-2.0",
        "Eclipse Public License - v 1.0": "EPL-1.0",
        "Boost Software License - Version 1.0": "BSL-1.0",
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": "LGPL-2.1",
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "GPL-2.0",
        "Licensed under the MIT License.": "MIT",
        "The license plate of the car was lost in a public domain.": None,
    }
    texts = spark.createDataFrame([(t, t) for t in lines], "key string, text string")
    got = {r["key"]: r["license"] for r in notices(texts).collect()}
    assert {t: got.get(t) for t in lines} == lines
