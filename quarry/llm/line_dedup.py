"""Cross-site boilerplate lines by distinct-site spread (native).

Every non-blank line is named by a 128-bit hash: two of independent seeds. A HyperLogLog sketch of its
sites is built and merged by aggregation, so a line that a third of all rows hold
costs one sketch a task. Lines whose estimate is clearly above or below the
threshold are settled; those near it get an exact count of distinct sites. Lines
on at least ``min_sites`` sites are removed from all documents.

Defined results: a null text stays null and has no lines; blank lines are kept; a
null site counts as one site; repeated rows get equal results; a text whose lines
all go becomes empty; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, SPACE, checkpoint, count_bounded, join_counted, let, row_key

MIN_SITES = 10

#: Sketches have 2**LG_K registers: a relative error of about 1.04 / sqrt(2**LG_K).
LG_K = 9

#: Standard errors within which an estimate doesn't settle a line.
NEAR = 5


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """(row_key, place, line, site) of every non-blank line, each named by its hash."""
    rows = docs.select(row_key().alias("row_key"), F.coalesce(F.col(site), F.lit("\0")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("place", "own"))
    return rows.filter(F.col("own").rlike(f"[^{SPACE}]")).select("row_key", "place", row_key("own").alias("line"), "site")


def _among(lines: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose line is one of ``members`` (line, n rows); no frequent line's rows meet in a task."""
    if count_bounded(members, BROADCAST_ROWS):
        return lines.join(F.broadcast(members.select("line")), "line", "left_semi")
    return join_counted(lines, members, "line")


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """(line, n): the hashes of lines on at least ``min_sites`` distinct sites, and their numbers of rows; exact."""
    lines = _lines(docs, site).select("line", "site")
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("*").alias("n"))
    estimate = sketches.select("line", "n", F.hll_sketch_estimate("sketch").alias("sites"))
    band = max(1.0, NEAR * 1.04 / 2 ** (LG_K / 2) * min_sites)
    wanted = checkpoint(estimate.filter(F.col("sites") >= min_sites - band))
    sure = wanted.filter(F.col("sites") > min_sites + band).select("line", "n")
    near = wanted.filter(F.col("sites") <= min_sites + band).select("line", "n")
    # Pairs are made distinct before they are counted, so a frequent line is combined where it is read.
    own = _among(lines, near).select("line", "site").distinct()
    exact = own.groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites).select("line")
    return checkpoint(sure.union(near.join(exact, "line")))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """(doc_id, n_lines, n_removed, text) for every row; ``text`` is without the boilerplate lines."""
    spread = spread_lines(docs, min_sites, site)
    places = _among(_lines(docs, site), spread).groupBy("row_key").agg(F.collect_set("place").alias("_drop"))
    own = docs.select("doc_id", "text", row_key().alias("row_key")).join(places.hint("shuffle_hash"), "row_key", "left")
    split = F.split("text", "\n", -1)
    drop = F.coalesce("_drop", F.array().cast("array<int>"))
    # The places that stay are told by one set, and their lines taken by place: linear in the lines.
    kept = F.when(F.size(drop) == 0, F.col("text")).otherwise(let(split, lambda x: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), drop), lambda i: F.get(x, i)), "\n"
    )))
    n_lines = F.coalesce(F.size(F.filter(split, lambda x: x.rlike(f"[^{SPACE}]"))), F.lit(0))
    return own.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.size(drop).cast("long").alias("n_removed"), kept.alias("text"))
