"""A persistent store of answers by key and version, from which only missing ones are asked.

Answers are appended in slices of the keys, each a write of its own, so a run that is
killed has lost at most the slice it was at. An append may happen twice or by two runs
at once; a key's winner is the first by time, then the least answer, and the same for every reader.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.scale import checkpoint, look_up

#: Slices in which missing keys are asked.
SLICES = 8


class Memo:
    """Answers below a folder that the cluster shares: (version, key, answer, asked_at)."""

    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version

    SCHEMA = "version string, key string, answer string, asked_at timestamp"

    def _stored(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def known(self) -> DataFrame:
        """(key, answer): one winner a key of this version."""
        own = self._stored().filter(F.col("version") == self.version)
        return own.groupBy("key").agg(F.min_by("answer", F.struct("asked_at", "answer")).alias("answer"))

    def add(self, answers: DataFrame) -> None:
        """Append (key, answer); null answers aren't stored."""
        rows = answers.filter(F.col("key").isNotNull() & F.col("answer").isNotNull()).select(F.lit(self.version).alias("version"), "key", "answer", F.current_timestamp().alias("asked_at"))
        rows.write.mode("append").parquet(self.folder)

    def missing(self, keys: DataFrame) -> DataFrame:
        """The different keys of ``keys`` (key, ...), with their other columns of one row, that have no answer yet."""
        others = [c for c in keys.columns if c != "key"]
        rows = keys.filter(F.col("key").isNotNull())
        once = rows.groupBy("key").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in others))).alias("_row")).select("key", "_row.*") if others else rows.distinct()
        return once.join(self.known().select("key"), "key", "left_anti")

    def answers(self, items: DataFrame, ask: Callable[[DataFrame], DataFrame], slices: int = SLICES) -> DataFrame:
        """``items`` (key, ...) with ``answer``; ``ask`` gets rows of different keys without an answer and gives (key, answer).

        Each slice of the missing keys is asked and stored before the next. Keys that get no
        answer stay null here, and are asked again by the next run; so are rows of a null key not at all.
        """
        missing = checkpoint(self.missing(items))
        for i in range(slices):
            part = missing.filter(F.pmod(F.xxhash64("key"), F.lit(slices)) == i)
            if not part.isEmpty():
                self.add(ask(part))
        return look_up(items.drop("answer"), checkpoint(self.known()), "key")
