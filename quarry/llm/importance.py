"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two bag-of-n-gram models over hashed buckets are counted: the target's from a
bounded sample of rows labelled good and not toxic, the raw one's from all
documents. A document's log weight is the sum over its n-grams of the log ratio
of the two. Adding Gumbel noise and taking the k largest draws k documents
without replacement in proportion to their weights. k is the share of good rows
among the labelled ones, times the number of documents, unless it is given.

Defined results: a null text has no n-grams and weight zero; repeated rows have
the same noise and weight, and rows that tie with the last one taken are taken
too; labels of a null or unknown doc_id are ignored, of a doc_id labelled twice
the worse counts; without good labels everything is kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ROW_KEY, checkpoint, row_key
from quarry.llm.selection import top_k_cut

#: Buckets of the hashed n-grams; a model is one number for each.
BUCKETS = 1 << 20

#: Equal slices in which buckets are added up; as many tasks at most share them.
SLICES = 1024
SLICE = BUCKETS // SLICES

#: Labelled good rows that the target model is fitted to, at most, by a hash of the id.
TARGET_ROWS = 20_000

#: Added to each bucket's count, with the raw counts brought to the target's size.
SMOOTHING = 5.0

SEED = 11

#: Words whose hashes a worker keeps.
CACHED = 300_000


def bucket_ids(raw: bytes | None, known: dict):
    """Buckets of the words and word pairs of a text; its A-Z are taken in lower case."""
    import numpy as np
    import xxhash

    words = raw.lower().split() if raw else []
    if len(known) > CACHED:
        known.clear()
    new = {w for w in words if w not in known}
    for w in new:
        known[w] = xxhash.xxh64_intdigest(w, SEED)
    one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] >> np.uint64(7)) if len(one) > 1 else one[:0]
    mixed = two * np.uint64(0xC2B2AE3D27D4EB4F)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([one >> shift, mixed >> shift]).astype(np.int64)


def _counts(docs: DataFrame) -> "np.ndarray":  # noqa: F821
    """Counts by bucket over all rows of ``docs`` (text, good), as a (2, BUCKETS) array: all rows, good rows.

    A task sends what it has met of each slice of the buckets as one row; slices
    are added up as they stream in, so no task holds more than its slices. The
    driver gets the sums, whose size BUCKETS bounds.
    """
    import numpy as np

    def count(batches):
        import numpy as np
        import pyarrow as pa

        total, known = np.zeros((2, BUCKETS), np.int64), {}
        for batch in batches:
            for raw, good in zip(batch.column("text").cast(pa.large_binary()), batch.column("good").to_pylist()):
                ids = bucket_ids(raw.as_py(), known)
                for kind in (0, 1) if good else (0,):
                    np.add.at(total[kind], ids, 1)
        for at in range(0, SLICES, 32):
            out: dict[str, list] = {"slice": [], "at": [], "n": []}
            for i in range(at, at + 32):
                own = total[:, i * SLICE : (i + 1) * SLICE]
                met = np.flatnonzero(own[0]).astype("<i4")
                out["slice"].append(i)
                out["at"].append(met.tobytes())
                out["n"].append(np.ascontiguousarray(own[:, met]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict(out)

    def add(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, at, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "at", "n"))):
                sums.setdefault(i, np.zeros((2, SLICE), np.int64))[:, np.frombuffer(at, "<i4")] += np.frombuffer(n, "<i8").reshape(2, -1)
        for i, x in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": [i], "n": [x.tobytes()]})

    parts = docs.select("text", "good").mapInArrow(count, "slice long, at binary, n binary")
    out = np.zeros((2, BUCKETS), np.int64)
    tasks = min(SLICES, max(32, docs.rdd.getNumPartitions() // 2))
    for i, n in parts.repartition(tasks, "slice").mapInArrow(add, "slice long, n binary").collect():
        out[:, i * SLICE : (i + 1) * SLICE] = np.frombuffer(n, np.int64).reshape(2, -1)
    return out


def log_ratios(counts):
    """The log of target over raw probability by bucket; zero for both unseen."""
    import numpy as np

    raw, target = counts.astype(np.float64)
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw), np.float32)
    return np.log((target + SMOOTHING) / (raw * (target.sum() / raw.sum()) + SMOOTHING)).astype(np.float32)


def importance(docs: DataFrame, labels: DataFrame, k: int | None = None, target_rows: int = TARGET_ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel, kept) for every row."""
    spark = docs.sparkSession
    judged = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.bool_and(F.col("quality") == 1) & F.bool_and(F.col("toxic") == 0)).alias("good"))
    total, good = judged.agg(F.count("*"), F.count_if("good")).first()
    # A bounded sample: the smallest hashes of ids, at most target_rows of them.
    draw = F.xxhash64("doc_id", F.lit(seed))
    fit = judged.filter("good").orderBy(draw, "doc_id").limit(target_rows).select(F.col("doc_id").alias("_labelled"), F.lit(True).alias("good"))
    fit = checkpoint(fit)
    marked = docs.select("doc_id", "text").join(F.broadcast(fit), F.col("doc_id") == F.col("_labelled"), "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    ratios = spark.sparkContext.broadcast(log_ratios(_counts(marked)))

    def score(batches):
        import pyarrow as pa

        known = {}
        for batch in batches:
            sizes, weights = [], []
            for raw in batch.column("text").cast(pa.large_binary()):
                ids = bucket_ids(raw.as_py(), known)
                sizes.append(len(ids))
                weights.append(float(ratios.value[ids].sum(dtype="float64")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())], ["doc_id", "row_key", "n_grams", "log_weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(score, f"doc_id {kind}, row_key {ROW_KEY}, n_grams long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "row_key", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    rows = checkpoint(scored.withColumn("gumbel", -F.log(-F.log(uniform))).withColumn("_key", F.col("log_weight") + F.col("gumbel")))
    n, low, high = rows.agg(F.count("*"), F.min("_key"), F.max("_key")).first()
    if k is None:
        k = math.ceil(n * good / total) if good else n
    cut = top_k_cut(rows, "_key", k, low, high) if n and k < n else float("-inf")
    kept = (F.col("_key") >= F.lit(cut)) if k > 0 else F.lit(False)
    return rows.select("doc_id", "n_grams", "log_weight", "gumbel", kept.alias("kept"))
