"""The stateless text steps over a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import clean_text, tokens
from quarry.operators.semfilter import FilterConfig, semantic_filter


def cleaned_stream(stream: DataFrame, make_tagger: Callable | None = None, config: FilterConfig = FilterConfig()) -> DataFrame:
    """``stream`` (text, ...) cleaned and, with a tagger, filtered; the same steps as over a table, without state."""
    rows = stream.withColumn("text", clean_text(F.col("text")))
    rows = semantic_filter(rows, make_tagger, config) if make_tagger else rows
    return rows.withColumn("n_words", F.size(tokens(F.col("text"))).cast("long"))


def run_once(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what the stream's source holds now, append it to ``out`` exactly once, and read that."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
