"""License scans by sparse TF-IDF cosine to templates and inheritance along paths (native).

Templates are notices of a line and whole licence texts. A unit is a line, compared
by each of its windows of as many words as a notice has, or a whole text, compared
with all templates. Its vector weighs a word by 1 + ln(count), times an inverse
document frequency over all documents that is bounded above; words outside the
templates have that bound. So scores don't fall as the table grows: from a thousand
documents on they depend on the share of documents that hold a word, not on their number.

What may be left out before scoring follows from the weights, not from a list: by the
Cauchy-Schwarz inequality a window can't reach the score if the notice's words that it
holds don't carry enough of the notice's weight, nor can a text with too much weight
outside the templates. Equal lines and texts are scored once.

The licence of a document is that of its whole text if that is near a whole licence text,
or near a notice where its name is a licence file's; else of its best line; failing
that, of the nearest ancestor directory that holds a licence file, found by joining its
ancestor paths with the files' directories. A short text with a notice licenses itself only.

Defined results: a null text has no header and may inherit; a null path inherits
nothing; a named licence goes before a claim of all rights, then the greater score
wins, then the licence last in order; repeated rows get equal results; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, checkpoint, count_bounded, join_counted, let, look_up, row_key

#: Notices of a line by licence.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache-2.0 license"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "3-Clause BSD License"), ("BSD-3-Clause", "under the BSD license"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "GNU General Public License version 3"), ("GPL-3.0", "version 3 of the GNU General Public License"), ("GPL-3.0", "GPL version 3"), ("GPL-3.0", "GPLv3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MIT", "Released under the MIT License."), ("MIT", "MIT License"), ("MIT", "licensed under MIT"), ("MIT", "SPDX-License-Identifier: MIT"), ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("proprietary", "All rights reserved."),
)

#: Licences that a claim of theirs goes behind any other.
UNNAMED = ("proprietary",)

#: Names of licence files, in any case and with any suffix.
FILE_NAMES = r"(?i)^(licen[sc]e|copying|notice)([.-].*)?$"

#: Sizes that stand for whole texts: compared with licence texts, and for licence files with notices as well.
WHOLE, NAMED = 0, -1

#: Inverse document frequencies at which words are told apart while the weight of a text is bounded.
BAND_EDGES = (1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.5)

HEADER_SCORE, FILE_SCORE = 0.9, 0.6

#: The greatest inverse document frequency: that of a word in none of a thousand documents.
MOST = math.log(1001) + 1

#: What lies between words; points and hyphens at a word's ends aren't part of it.
BETWEEN = r"[.-]*[^\p{L}\p{N}.-]+[.-]*"


@functools.lru_cache(maxsize=1)
def texts() -> tuple[tuple[str, str], ...]:
    """The whole licence texts that stand beside this module."""
    return tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "templates").glob("*.txt")))


def template_words(text: str) -> list[str]:
    return [x for w in re.split(r"(?:[^\w.-]|_)+", text.lower()) if (x := w.strip(".-"))]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), BETWEEN, -1), "")


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """The number of documents, and how many hold each term; the driver gets one row a term."""
    own = docs.select(F.array_distinct(F.filter(_words(F.coalesce("text", F.lit(""))), lambda w: w.isin(terms))).alias("own"))
    rows = own.select(F.explode(F.array_append(F.col("own"), F.lit(""))).alias("term")).groupBy("term").count()
    counts = dict(rows.collect())
    return counts.pop("", 0), counts


class Weights:
    """Bounded inverse document frequencies and the templates' unit vectors, by the size of what they are compared with."""

    def __init__(self, n: int, df: dict[str, int], notices=NOTICES, whole=None):
        whole = texts() if whole is None else whole
        self.terms = vocabulary(notices, whole)
        self.idf = {t: min(MOST, math.log((n + 1) / (df.get(t, 0) + 1)) + 1) for t in self.terms}
        own = [(len(template_words(t)), name, t) for name, t in notices] + [(WHOLE, name, t) for name, t in whole] + [(NAMED, name, t) for name, t in (*notices, *whole)]
        self.templates = [(size, name, self._vector(t)) for size, name, t in own]
        self.sizes = sorted({size for size, _, _ in self.templates} - {WHOLE, NAMED})

    def _vector(self, text: str) -> dict[str, float]:
        v = {t: (1 + math.log(k)) * self.idf[t] for t, k in Counter(template_words(text)).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    def needed(self) -> list[str]:
        """Words of which a window of HEADER_SCORE must hold one: without a notice's heaviest the rest can't reach it."""
        out = set()
        for size, _, v in self.templates:
            left = 1.0
            for t in sorted(v, key=lambda t: (-v[t], t)) if size > 0 else ():
                if left < HEADER_SCORE**2 - 1e-6:
                    break
                out.add(t)
                left -= v[t] ** 2
        return sorted(out)

    def notices(self, size: int | None = None) -> list[dict[str, float]]:
        """The vectors of the notices of ``size`` words, or of all."""
        return list({tuple(sorted(v.items())): v for n, _, v in self.templates if (n == size if size else n > 0)}.values())

    def bands(self) -> list[tuple[float, list[str]]]:
        """(bound, words) of the templates' words by their inverse document frequency, none of which is above the bound."""
        edges = (*BAND_EDGES, MOST)
        parts: dict[float, list[str]] = {}
        for t in self.terms:
            parts.setdefault(next((e for e in edges if self.idf[t] <= e), MOST), []).append(t)
        return sorted(parts.items())


def vocabulary(notices=NOTICES, whole=None) -> list[str]:
    return sorted({w for _, t in (*notices, *(texts() if whole is None else whole)) for w in template_words(t)})


def _reaches(words: Column, vectors: list[dict[str, float]], least: float) -> Column:
    """Whether ``words`` hold words that carry enough of one of the unit ``vectors`` for a cosine of ``least``: its part of them is a bound."""
    terms = sorted({t for v in vectors for t in v})
    held = lambda known, v: sum((F.when(F.array_contains(known, t), x * x).otherwise(0.0) for t, x in sorted(v.items())), F.lit(0.0)) >= least**2 - 1e-6
    return let(F.filter(words, lambda w: w.isin(terms)), lambda known: functools.reduce(lambda a, b: a | b, (held(known, v) for v in vectors)))


def _candidates(docs: DataFrame, weights: Weights) -> DataFrame:
    """(row_key, path, named, lines, whole) of the rows that may have a header or be a file: the lines and the text to score.

    What is left out can't reach the score. Of d different words of a band, k in all, the
    squared weights are at most d (1 + ln(k / d))^2 times the square of the band's bound
    (the function is concave), and those of each word outside the templates MOST^2.
    Texts are taken apart where they are read and not shuffled.
    """
    needed, share = weights.needed(), FILE_SCORE**2 / (1 - FILE_SCORE**2)
    bands = weights.bands()
    name = F.element_at(F.split(F.coalesce("path", F.lit("")), "/", -1), -1)
    # The row number keeps later filters above this projection; below it they would take the words apart again.
    rows = docs.filter(F.col("text").isNotNull()).select("row_key", "path", "text", name.rlike(FILE_NAMES).alias("named"), _words(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("n"))
    rows = rows.select("row_key", "path", "named", "text", "n", F.filter("words", lambda w: w.isin(weights.terms)).alias("known"), F.size(F.array_distinct("words")).alias("several"))
    within = lambda own: F.filter("known", lambda w: w.isin(own))
    parts = [within(own) for _, own in bands]
    counted = F.array(*(F.struct(F.lit(bound**2).alias("bound"), F.size(p).alias("k"), F.size(F.array_distinct(p)).alias("d")) for (bound, _), p in zip(bands, parts)))
    # Bands are counted where one band of the greatest bound doesn't rule the text out already.
    rows = rows.select("*", F.size("known").alias("k"), F.size(F.array_distinct("known")).alias("d"), F.exists("known", lambda w: w.isin(needed)).alias("header"))
    loose = (F.col("d") > 0) & (F.col("d") * F.pow(1 + F.log(F.col("k") / F.col("d")), F.lit(2.0)) * (1 + 1e-9) >= share * (F.col("several") - F.col("d")))
    counts = F.when(loose, counted).otherwise(F.array().cast("array<struct<bound:double,k:int,d:int>>"))
    rows = rows.select("row_key", "path", "named", "text", "n", "several", counts.alias("counts"), "header")
    known = F.aggregate("counts", F.lit(0.0), lambda acc, x: acc + F.when(x["d"] > 0, x["bound"] * x["d"] * F.pow(1 + F.log(x["k"] / x["d"]), F.lit(2.0))).otherwise(0.0))
    others = F.col("several") - F.aggregate("counts", F.lit(0), lambda acc, x: acc + x["d"])
    rows = rows.select("row_key", "path", "named", "text", "n", "header", known.alias("known"), others.alias("others"))
    may_be_file = (F.col("n") >= 0) & (F.col("known") > 0) & (F.col("known") * (1 + 1e-9) >= share * MOST**2 * F.col("others"))
    line = lambda x: let(_words(x), lambda w: F.exists(w, lambda v: v.isin(needed)) & _reaches(w, weights.notices(), HEADER_SCORE))
    lines = F.filter(F.split("text", r"\n", -1), line)
    held = rows.filter((F.col("header") & (F.col("n") >= 0)) | may_be_file)
    return held.select("row_key", "path", "named", F.when(F.col("header"), lines).otherwise(F.array().cast("array<string>")).alias("lines"), F.when(may_be_file, F.col("text")).alias("whole"))


def _scored(units: DataFrame, weights: Weights, least: float) -> DataFrame:
    """(k, best) of the units of which a window (k, size, at, words) scores at ``least``; ``best`` is struct(named, score, license)."""
    spark = units.sparkSession
    terms = spark.createDataFrame(list(weights.idf.items()), "word string, idf double")
    vectors = spark.createDataFrame([(size, i, t, x) for i, (size, _, v) in enumerate(weights.templates) for t, x in v.items()], "size int, template int, word string, weight double")
    names = spark.createDataFrame([(i, name, name not in UNNAMED) for i, (_, name, _) in enumerate(weights.templates)], "template int, license string, named boolean")
    counts = units.select("k", "size", "at", F.explode("words").alias("word")).groupBy("k", "size", "at", "word").agg(F.count("*").alias("n"))
    weighed = counts.join(F.broadcast(terms), "word", "left").select("k", "size", "at", "word", ((1 + F.log("n")) * F.coalesce("idf", F.lit(MOST))).alias("x"))
    weighed = checkpoint(weighed)
    length = weighed.groupBy("k", "size", "at").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dots = weighed.join(F.broadcast(vectors), ["size", "word"]).groupBy("k", "size", "at", "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    found = dots.join(length, ["k", "size", "at"]).join(F.broadcast(names), "template")
    near = found.withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).filter(F.col("score") >= least)
    return near.groupBy("k").agg(F.max(F.struct("named", "score", "license")).alias("best"))


def _units(rows: DataFrame, words) -> DataFrame:
    """Each distinct text of ``rows`` (k, text, named) once, as its windows."""
    own = rows.groupBy("k").agg(F.min("text").alias("text"), F.min("named").alias("named"))
    return own.select("k", F.explode(words(_words(F.col("text")))).alias("u")).select("k", "u.size", "u.at", "u.words")


def _windows(weights: Weights):
    """Windows that hold enough of a notice of their size; no other can reach the score, so a long line has few."""
    needed = weights.needed()

    def of(size: int, w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - size))
        own = F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), i.alias("at"), F.slice(w, i + 1, size).alias("words")))
        return F.filter(own, lambda x: F.exists(x["words"], lambda v: v.isin(needed)) & _reaches(x["words"], weights.notices(size), HEADER_SCORE))

    return lambda words: let(words, lambda w: F.flatten(F.array(*(of(size, w) for size in weights.sizes))))


def _texts(words: Column) -> Column:
    """The whole text as one unit, of a size that says what it is compared with."""
    return F.array(F.struct(F.when(F.col("named"), NAMED).otherwise(WHOLE).alias("size"), F.lit(0).alias("at"), words.alias("words")))


def _back(rows: DataFrame, best: DataFrame) -> DataFrame:
    """(row_key, path, best) of ``rows`` (row_key, path, k, ...) whose k has a score; no frequent line's rows meet in a task."""
    members = checkpoint(rows.groupBy("k").agg(F.count("*").alias("n")).join(best, "k"))
    return join_counted(rows.select("row_key", "path", "k"), members, "k")


def license_scan(docs: DataFrame, path: Column, notices=NOTICES, whole=None) -> DataFrame:
    """(doc_id, path, license, origin, score) for every row; origin is header, inherited or null."""
    docs = docs.select("doc_id", path.alias("path"), "text", row_key("doc_id", "text", path).alias("row_key"))
    weights = Weights(*document_frequencies(docs, vocabulary(notices, whole)), notices, whole)

    held = checkpoint(_candidates(docs, weights))
    lines = held.select("row_key", "path", "named", F.explode("lines").alias("text")).distinct().withColumn("k", row_key("text"))
    lines = checkpoint(lines)
    files = held.filter(F.col("whole").isNotNull()).select("row_key", "path", "named", F.col("whole").alias("text")).dropDuplicates(["row_key"]).withColumn("k", row_key("text", "named"))

    line_best = _scored(_units(lines, _windows(weights)), weights, HEADER_SCORE)
    text_best = _scored(_units(files, _texts), weights, FILE_SCORE)
    by_line = _back(lines, line_best).groupBy("row_key").agg(F.max("best").alias("line"))
    whole_files = checkpoint(_back(files, text_best).select("row_key", "path", F.col("best").alias("file")))

    parts = F.split("path", "/", -1)
    parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    directories = checkpoint(whole_files.filter(F.size(parts) > 1).groupBy(parent.alias("dir")).agg(F.max("file").alias("found")))

    header = checkpoint(by_line.join(whole_files.select("row_key", "file"), "row_key", "full").select("row_key", F.coalesce("file", "line").alias("header")))
    rows = checkpoint(look_up(docs.select("doc_id", "path", "row_key"), header, "row_key"))
    open_rows = rows.filter(F.col("header").isNull() & (F.size(parts) > 1)).select("row_key", "path").distinct()
    ancestors = open_rows.select("row_key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))).alias("a")).select("row_key", "a.depth", "a.dir")
    if count_bounded(directories, BROADCAST_ROWS):
        met = ancestors.join(F.broadcast(directories), "dir")
    else:
        met = join_counted(ancestors, checkpoint(ancestors.groupBy("dir").agg(F.count("*").alias("n")).join(directories, "dir")), "dir")
    inherited = checkpoint(met.groupBy("row_key").agg(F.max_by("found", "depth").alias("above")))
    own = F.coalesce("header", "above")
    return look_up(rows, inherited, "row_key").select(
        "doc_id", "path", own["license"].alias("license"),
        F.when(F.col("header").isNotNull(), "header").when(F.col("above").isNotNull(), "inherited").alias("origin"), own["score"].alias("score"),
    )
