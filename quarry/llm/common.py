"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: space and U+0009 to U+000D (fixed by the contracts).
SPACE = r"\x20\x09-\x0D"

#: A side of a join is broadcast only when it is known to have at most so many rows.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``; only a local session without that
    setting (as in tests) gets a temporary folder of its own, a cluster an error.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="quarry-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def count_bounded(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than it must."""
    return df.limit(bound + 1).count() <= bound


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The type of :func:`row_key`.
ROW_KEY = "struct<a:bigint,b:bigint>"


def row_key(*columns) -> Column:
    """128 bits that tell rows apart whose doc_id is null or repeated with another text: two hashes of independent seeds."""
    own = [F.col(c) if isinstance(c, str) else c for c in columns or ("doc_id", "text")]
    return F.struct(F.xxhash64(F.lit("a"), *own).alias("a"), F.xxhash64(F.lit("another"), *own).alias("b"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The maximal runs without white space, as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), "")


def heavy_keys(members: DataFrame) -> Column:
    """Whether a row of ``members`` (key, n, ...) has over a thousandth of all rows; fewer than a thousand have."""
    return F.col("n") > (members.agg(F.sum("n")).first()[0] or 0) // 1000


def join_counted(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``members`` (key, n, ...), where ``n`` is the number of rows of a key.

    Keys with over a thousandth of the rows are fewer than a thousand, which
    bounds what is broadcast; the other keys are shuffled. No key's rows meet in
    one task.
    """
    often = heavy_keys(members)
    heavy = F.broadcast(members.filter(often).drop("n"))
    light = members.filter(~often).drop("n")
    return rows.join(heavy, key).unionByName(rows.join(heavy, key, "left_anti").join(light, key))


def look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with ``table``, of one row a key, in which no frequent key's rows meet in one task."""
    if count_bounded(table, BROADCAST_ROWS):
        return rows.join(F.broadcast(table), key, "left")
    counts = checkpoint(rows.groupBy(key).agg(F.count("*").alias("n")))
    heavy = counts.filter(heavy_keys(counts)).select(key)
    own = F.broadcast(checkpoint(heavy.join(table, key, "left").withColumn("_heavy", F.lit(True))))
    often = rows.join(own, key).drop("_heavy")
    return often.unionByName(rows.join(F.broadcast(heavy), key, "left_anti").join(table, key, "left"))


def rows_in(docs: DataFrame, keys: DataFrame, how: str, one: bool = False) -> DataFrame:
    """The rows of ``docs`` whose row key is (``left_semi``) or isn't (``left_anti``) one of ``keys`` (key, n), with all their columns.

    ``n`` is the number of rows of the key. Rows of frequent keys are found by a
    broadcast, so copies of one row never meet in a task, nor do their texts
    move; with ``one`` a single row of each key is left, first in each task.
    """
    name = fresh(docs, "_row_key")
    keyed = docs.withColumn(name, row_key())
    often = heavy_keys(keys)
    keys = keys.withColumnRenamed("key", name)
    heavy, light = F.broadcast(keys.filter(often).select(name)), keys.filter(~often)
    rest = light.select(name).hint("shuffle_hash")
    if how == "left_anti":
        return keyed.join(heavy, name, how).join(rest, name, how).drop(name)
    if not one:
        return keyed.join(heavy, name, how).unionByName(keyed.join(rest, name, how)).drop(name)
    few = keyed.join(light.filter("n = 1").select(name).hint("shuffle_hash"), name, how)
    again = keyed.join(heavy, name, how).unionByName(keyed.join(light.filter("n > 1").select(name).hint("shuffle_hash"), name, how))
    return few.unionByName(again.dropDuplicates([name])).drop(name)
