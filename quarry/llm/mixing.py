"""Mixing sources to target weights by hash thresholds.

Each document has a fixed hash of its id and text. A source takes every document
as often as its target holds its size in full, and once more those whose hash is
below a threshold at which the taken sizes reach the rest. The threshold is found
without sorting: sizes are summed by source and hash bucket, the bucket in which
the budget runs out is the only one that is opened into finer buckets, and so on
to single hashes. A smaller budget has a lower threshold for the same hashes, so
its documents are a subset of those of a larger one.

Defined results: a null text has size zero; a null source is a source of its own,
last in order; rows of equal id and text have the same hash, and where that is the
threshold, so many of them are taken as come nearest to the budget, by a hash of their places; a source
of size zero has target zero; an empty table gives an empty result; further
columns are carried by :func:`take` and ignored by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, checkpoint, count_bounded, fresh

WEIGHTS, MOST_TIMES, SEED = (5, 2, 1), 3, 42

#: Bits of the hash that one histogram tells apart; so many levels reach a single hash.
LEVEL_BITS, LEVELS = 13, 5


def _hash(doc_id: str = "doc_id", text: str = "text"):
    """The top 63 bits of a hash of the id and text, non-negative: rows of one id, or without, are told apart."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), doc_id, text), 1)


def _place() -> Column:
    """The top 63 bits of a hash of a row's place in its table, which parts rows of equal id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.monotonically_increasing_id()), 1)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h, place)."""
    size = F.size(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), " "))
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return docs.select(
        "doc_id", "source",
        F.when(blank, 0).otherwise(size).cast("long").alias("size"),
        _hash().alias("h"), _place().alias("place"),
    )


def ranked(table: DataFrame, order: list, partitions: int) -> DataFrame:
    """``table`` with ``rank`` from 0 in the order given; no task gets more than its range.

    Ranks in a range are added to the ranges' prefix sums; the driver holds one
    number for each partition.
    """
    dealt = checkpoint(table.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id()))
    base, bases = 0, []
    for part, n in sorted(dealt.groupBy("_part").count().collect()):
        bases.append((part, base))
        base += n
    if not bases:
        return dealt.select("*", F.lit(0).cast("long").alias("rank")).drop("_part")
    bases = table.sparkSession.createDataFrame(bases, "_part int, _base long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(bases), "_part").withColumn("rank", F.col("_base") + place - 1).drop("_part", "_base")


def targets(by_source: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    All sizes are shared by weight; a target stops at its cap and the excess goes
    to the others by weight. That is target = least(cap, level * weight) for the
    level at which targets add up to the total; it rises until no further source
    reaches its cap.
    """
    order = [F.col("source").asc_nulls_last()]
    table = ranked(by_source, order, 8)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = checkpoint(table.withColumn("w", weight).withColumn("cap", (F.col("source_size") * most_times).cast("double")))
    level, known = 0.0, None
    while True:
        at_cap = F.col("cap") <= level * F.col("w")
        n, capped, open_weight, total = table.agg(F.count_if(at_cap), F.sum(F.when(at_cap, F.col("cap"))), F.sum(F.when(~at_cap, F.col("w"))), F.sum("source_size")).first()
        if n == known or not open_weight:
            break
        known, level = n, (float(total) - (capped or 0.0)) / open_weight
    target = F.when(F.col("source_size") > 0, F.least(F.col("cap"), F.lit(level) * F.col("w"))).otherwise(0.0)
    return table.select("source", "source_size", target.alias("target"))


def _sent(df: DataFrame, small: bool) -> DataFrame:
    """``df``, of a row a source, marked for broadcast if there are few sources; otherwise left to be shuffled."""
    return F.broadcast(df) if small else df


def thresholds(rows: DataFrame, budgets: DataFrame, small: bool) -> DataFrame:
    """(source, at, left, n, rows): the hash at which a source's documents fill its ``budget``.

    ``left`` is what the hashes before it leave of the budget, ``n`` the size of the
    ``rows`` that have it. One narrow histogram a level: after the first, only rows in a
    source's open bucket count. The last bucket is a single hash.
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    opened = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("low"))
    width = 63
    for _ in range(LEVELS):
        step = max(0, width - LEVEL_BITS)
        o, r = _sent(opened, small).alias("o"), rows.alias("r")
        inside = r.join(o, same("r", "o")).select(
            F.col("r.source").alias("source"), "size", F.shiftrightunsigned(F.col("h") - F.col("low"), step).alias("bucket"),
            ((F.col("h") >= F.col("low")) & (F.shiftrightunsigned(F.col("h") - F.col("low"), width) == 0) if width < 63 else F.lit(True)).alias("inside"),
        )
        histogram = inside.filter("inside").groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        running = histogram.withColumn("before", before)
        b, o = running.alias("b"), _sent(opened, small).alias("o")
        boundary = b.join(o, same("b", "o")).filter(F.col("before") <= F.col("left"))
        last = boundary.groupBy(F.col("b.source").alias("source")).agg(F.max(F.struct("bucket", "before", "n", "left", "low", "rows")).alias("x"))
        left = F.col("x.left") - F.col("x.before")
        start = F.col("x.low") + F.shiftleft(F.col("x.bucket"), step)
        if not step:
            return checkpoint(last.select("source", start.alias("at"), left.alias("left"), "x.n", "x.rows"))
        opened = checkpoint(last.select("source", left.alias("left"), start.alias("low")))
        width = step
    raise AssertionError("the levels don't reach a single hash")


def _nearer(found: DataFrame) -> Column:
    """The value below which hashes are taken: that of :func:`thresholds` counts if it comes nearer to the budget."""
    return F.col("at") + F.when(F.col("left") * 2 >= F.col("n"), 1).otherwise(0)


def cuts(rows: DataFrame, budgets: DataFrame, small: bool) -> DataFrame:
    """(source, below, shared, within): a row is taken if its hash is less than ``below``, or is ``shared`` and its place is less than ``within``."""
    found = thresholds(rows, budgets, small)
    one = found.filter("rows = 1").select("source", _nearer(found).alias("below"), F.lit(None).cast("long").alias("shared"), F.lit(None).cast("long").alias("within"))
    many = found.filter("rows > 1")
    if many.isEmpty():
        return one
    m, r = _sent(many, small).alias("m"), rows.alias("r")
    copies = r.join(m, F.col("r.source").eqNullSafe(F.col("m.source")) & (F.col("h") == F.col("at"))).select("r.source", "size", F.col("place").alias("h"))
    inner = thresholds(checkpoint(copies), many.select("source", F.col("left").alias("budget")), small)
    i, m = inner.select(F.col("source").alias("s"), _nearer(inner).alias("within")), many.select("source", "at")
    both = m.join(_sent(i, small), F.col("source").eqNullSafe(F.col("s")))
    return one.unionByName(both.select("source", F.col("at").alias("below"), F.col("at").alias("shared"), "within"))


def plan(rows: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES, budget: float = 1.0) -> DataFrame:
    """(source, source_size, target, whole, below, shared, within) from the rows of :func:`sizes`, marked for broadcast if there are few sources.

    A document is taken ``whole`` times, and once more as :func:`cuts` says.
    """
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_times)
    by_source = by_source.withColumn("target", F.col("target") * budget)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    by_source = checkpoint(by_source.withColumn("whole", whole))
    small = count_bounded(by_source, BROADCAST_ROWS)
    budgets = by_source.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    s, b = by_source.alias("s"), _sent(checkpoint(cuts(rows, budgets, small)), small).alias("b")
    joined = s.join(b, F.col("s.source").eqNullSafe(F.col("b.source")), "left")
    return _sent(checkpoint(joined.select("s.*", F.coalesce("below", F.lit(0)).cast("long").alias("below"), "shared", "within")), small)


def _times(h: Column, place: Column, most_times: int) -> Column:
    """How often a document is taken; rounding never takes it more often than allowed."""
    more = (h < F.col("p.below")) | F.coalesce((h == F.col("p.shared")) & (place < F.col("p.within")), F.lit(False))
    times = F.col("p.whole") + F.when(more, 1).otherwise(0)
    return F.least(times, F.lit(most_times)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES, budget: float = 1.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times) for every row; ``budget`` is the share of all sizes to take."""
    rows = checkpoint(sizes(docs))
    found = plan(rows, weights, most_times, budget).alias("p")
    out = rows.alias("r").join(found, F.col("r.source").eqNullSafe(F.col("p.source")))
    times = _times(F.col("r.h"), F.col("r.place"), most_times)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def take(docs: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """The rows of ``docs`` in the mix, each as often as it is taken; their texts aren't shuffled.

    ``docs`` is read twice, and its rows' places must be the same both times, as those of a stored table are.
    """
    found = plan(checkpoint(sizes(docs)), weights, most_times).alias("p")
    name = fresh(docs, "_place")
    joined = docs.withColumn(name, _place()).alias("d").join(found, F.col("d.source").eqNullSafe(F.col("p.source")))
    times = _times(_hash("d.doc_id", "d.text"), F.col(f"d.{name}"), most_times)
    copies = joined.select("d.*", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return copies.select(*(F.col(f"`{c}`") for c in docs.columns))
