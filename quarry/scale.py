"""What plans need to hold at any size: the shared folder, lineage cuts, size checks and joins without hot tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

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


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def count_bounded(df: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than it must."""
    return df.limit(bound + 1).count() <= bound


def look_up(rows: DataFrame, table: DataFrame, key: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``rows`` with ``table``, of one row a key.

    A table of at most ``bound`` rows is broadcast. Of a larger one, the keys that over
    a thousandth of all rows have, fewer than a thousand, are broadcast and the rest
    shuffled, so the rows of no key meet in one task.
    """
    if count_bounded(table, bound):
        return rows.join(F.broadcast(table), key, "left")
    counts = checkpoint(rows.groupBy(key).agg(F.count("*").alias("n")))
    often = (counts.agg(F.sum("n")).first()[0] or 0) // 1000
    heavy = counts.filter(F.col("n") > often).select(key)
    own = F.broadcast(checkpoint(heavy.join(table, key, "left")))
    return rows.join(own, key).unionByName(rows.join(F.broadcast(heavy), key, "left_anti").join(table, key, "left"))


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than shuffles have. Unions add up those of their sides, so loops that look up must not keep them."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
