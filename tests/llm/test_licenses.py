import math
import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.llm import licenses as L
from tests.llm.fixtures import documents, empty, whole


def words_of(text):
    return [w.strip(".-") for w in re.findall(r"(?:[^\W_]|[.-])+", (text or "").lower()) if w.strip(".-")]


class Slow:
    """Cosines worked out anew from the templates' texts, over every window and every text."""

    def __init__(self, docs):
        whole = [(p.stem, p.read_text()) for p in sorted(Path(L.__file__).parent.glob("templates/*.txt"))]
        own = [set(words_of(t)) for _, _, t in docs]
        self.most, n = math.log(1001) + 1, len(docs)
        self.idf = {}
        for _, t in [*L.NOTICES, *whole]:
            for w in words_of(t):
                if w not in self.idf:
                    self.idf[w] = min(self.most, math.log((n + 1) / (sum(w in x for x in own) + 1)) + 1)
        self.notices = [(name, len(words_of(t)), self.vector(words_of(t))) for name, t in L.NOTICES]
        self.whole = [(name, self.vector(words_of(t))) for name, t in whole]

    def vector(self, words):
        v = {w: (1 + math.log(words.count(w))) * self.idf.get(w, self.most) for w in set(words)}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    def best(self, words, templates, least):
        v = self.vector(words) if words else {}
        found = ((name != "proprietary", round(sum(x * t.get(w, 0) for w, x in v.items()), 6), name) for name, t in templates)
        return max((x for x in found if x[1] >= least), default=None)

    def line(self, text):
        w = words_of(text)
        found = []
        for size in {n for _, n, _ in self.notices}:
            own = [(name, t) for name, n, t in self.notices if n == size]
            found += [self.best(w[i : i + size], own, 0.9) for i in range(max(0, len(w) - size) + 1)]
        return max(filter(None, found), default=None)

    def file(self, text, path):
        """Whole licence texts make a file anywhere, notices one that is called a licence."""
        name = (path or "").rsplit("/", 1)[-1].lower()
        named = any(name == x or name.startswith((x + ".", x + "-")) for x in ("license", "licence", "copying", "notice"))
        return self.best(words_of(text), self.whole + [(n, v) for n, _, v in self.notices] * named, 0.6)


def slow(docs):
    """Rows (doc_id, path, text) to (doc_id, licence, origin, score)."""
    scores, own, dirs = Slow(docs), {}, {}
    for i, (_, path, text) in enumerate(docs):
        if text is None:
            continue
        file = scores.file(text, path)
        lines = [x for x in map(scores.line, text.split("\n")) if x]
        if file or lines:
            own[i] = file or max(lines)
        if file and path and "/" in path:
            d = path.rsplit("/", 1)[0]
            dirs[d] = max(dirs.get(d, file), file)
    out = []
    for i, (doc_id, path, _) in enumerate(docs):
        best, origin = own.get(i), "header"
        parts = (path or "").split("/")
        if not best:
            best = next((dirs["/".join(parts[:k])] for k in range(len(parts) - 1, 0, -1) if "/".join(parts[:k]) in dirs), None)
            origin = "inherited"
        out.append((str(doc_id), best and best[2], best and origin, best and best[1]))
    return out


def compare(df, expected):
    got = sorted(map(str, ((str(r.doc_id), r.license, r.origin) for r in df.collect())))
    assert got == sorted(str(x[:3]) for x in expected)
    scores = sorted(r.score or 0 for r in df.collect())
    assert scores == pytest.approx(sorted(x[3] or 0 for x in expected), abs=2e-6)


PATHS = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code"), (3, "a/b/c/y.py", None), (4, "a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (5, "a/b/c/d/z.py", "more code"), (6, "a/b/w.py", "# All rights reserved.\n" + "and code that does something " * 9), (7, "q/z.py", "nothing"), (8, None, "x"), (9, "top", "x"), (10, "", ""),
    (11, "a/b/c", "a file named as a folder"), (2, "a/b/x.py", "code"),
]


def test_inheritance(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x", p, 0) for i, p, t in PATHS], "doc_id long, text string, lang string, source string, n_chars long, _row_key string, h string, rank int")
    got = {r.doc_id: (r.license, r.origin) for r in L.license_scan(df, F.col("h")).collect()}
    assert got[2] == ("MIT", "inherited") and got[3] == ("Apache-2.0", "inherited") and got[5] == ("Apache-2.0", "inherited") and got[6] == ("proprietary", "header")
    assert got[7] == got[8] == got[9] == (None, None) and got[11] == ("MIT", "inherited")
    compare(L.license_scan(df, F.col("h")), slow(PATHS))


def test_whole_table(spark, sf_dir):
    docs = whole(spark, sf_dir)
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.lit("en"), F.col("doc_id").cast("string"))
    expected = slow([(d, f"{s}/en/{d}", t) for d, t, s in docs])
    assert sum(x[1] is not None for x in expected) > 3
    compare(L.license_scan(documents(spark, docs), path), expected)


def test_empty_and_native(spark):
    assert L.license_scan(empty(spark), F.col("source")).count() == 0
    assert "Python" not in L.license_scan(documents(spark), F.col("source"))._jdf.queryExecution().executedPlan().toString()


MIT_TEXT = """Copyright (c) 2024 Acme Corp.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

BSD_TEXT = """Copyright (c) 2024 Acme Corp.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""


@pytest.mark.parametrize("n", [10**3, 10**4, 12 * 10**6, 10**9])
def test_licence_is_found_at_every_table_size(spark, monkeypatch, n):
    monkeypatch.setattr(L, "document_frequencies", lambda docs, terms: (n, {}))
    lines = {
        1: ("Code released under the MIT License.", "MIT"), 2: ("Licensed under the Apache License, Version 2.0 by the Acme Authors.", "Apache-2.0"),
        3: ("Copyright (c) 2024 Acme Corp. Licensed under the MIT License.", "MIT"), 4: ("x = 1\n# SPDX-License-Identifier: MIT\ny = 2", "MIT"),
        5: ("SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"), 6: ("Copyright (c) 2024 Acme Corp. All rights reserved.\nThis code has the MIT license", "MIT"),
        7: ("SPDX-License-Identifier: LGPL-3.0", None), 8: ("SPDX-License-Identifier: MIT-0", None), 9: ("Copyright of the limit licenses", None),
    }
    rows = [(i, f"l{i}/x.py", t) for i, (t, _) in lines.items()]
    files = {"mit": ("MIT", MIT_TEXT), "bsd": ("BSD-3-Clause", BSD_TEXT)}
    common = "/usr/share/common-licenses"
    for name, licence in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0")):
        if os.path.exists(f"{common}/{name}"):
            files[name] = (licence, Path(common, name).read_text())
    for i, (name, (licence, text)) in enumerate(files.items()):
        rows += [(100 + 2 * i, f"{name}/LICENSE", text), (101 + 2 * i, f"{name}/src/a.py", "code")]
        lines[101 + 2 * i] = ("", licence)
        if licence:
            lines[100 + 2 * i] = ("", licence)
    got = {r.doc_id: r.license for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert {i: got[i] for i in lines} == {i: x for i, (_, x) in lines.items()}


@pytest.mark.parametrize("n", [10**3, 10**6, 10**9])
def test_scores_hold_where_shares_of_words_hold(n):
    """A word's weight depends on the share of documents that hold it, and on nothing else from a thousand documents on."""
    w = L.Weights(n, {"the": n // 2, "software": n // 100})
    assert w.idf["the"] == pytest.approx(1 + math.log(2), abs=2e-3) and w.idf["software"] == pytest.approx(1 + math.log(100), abs=0.1)
    assert w.idf["merchantability"] == pytest.approx(L.MOST)


def test_what_is_left_out_before_scoring_cannot_reach_the_score():
    w = L.Weights(1000, {"the": 500, "license": 3})
    needed = set(w.needed())
    for size, _, v in w.templates:
        if size > 0:
            assert math.sqrt(sum(x * x for t, x in v.items() if t not in needed)) < L.HEADER_SCORE


def test_a_line_that_many_rows_hold(spark):
    rows = [(i, f"d/{i}", f"own {i}\nReleased under the MIT License.\nmore") for i in range(3000)] + [(5000 + i, f"e/{i}", "plain") for i in range(3000)]
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).groupBy("license", "origin").count().collect()
    assert sorted(map(str, map(tuple, got))) == ["('MIT', 'header', 3000)", "(None, None, 3000)"]


def test_short_prose_with_a_notice_licenses_itself_only(spark):
    rows = [(1, "s/en/1", "A.\nAll rights reserved."), (2, "s/en/2", "Ie, des. Heitbe.\nLicensed under the Apache License, Version 2.0."), (3, "s/en/3", "plain words"), (4, "t/COPYING.txt", "Released under the MIT License."), (5, "t/x/a.py", "code")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in L.license_scan(df, F.col("path")).collect()}
    assert got == {1: ("proprietary", "header"), 2: ("Apache-2.0", "header"), 3: (None, None), 4: ("MIT", "header"), 5: ("MIT", "inherited")}


def test_real_prose_gives_few_windows(spark):
    """Of licence prose and documentation beside it, only lines that may be notices are taken apart."""
    prose = [f"This is the general documentation of version {i}: all of the license terms and any other files are described here." for i in range(400)]
    texts = [t for _, t in L.texts()] + ["\n".join(prose[i : i + 40]) for i in range(0, 400, 40)]
    df = spark.createDataFrame([(i, f"d/{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string").withColumn("row_key", F.struct(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")))
    weights = L.Weights(*L.document_frequencies(df, L.vocabulary()))
    held = L._candidates(df, weights)
    lines = held.select("row_key", "path", "named", F.explode("lines").alias("text")).withColumn("k", F.col("text"))
    n_windows, n_words = L._units(lines, L._windows(weights)).agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    assert n_words * 20 < sum(len(words_of(t)) for t in texts) and n_windows < 200
    whole = {r.path for r in held.filter("whole IS NOT NULL").collect()}
    assert whole >= {f"d/{i}" for i in range(len(L.texts()))} and len(whole) <= len(L.texts()) + 2
