"""Importance resampling towards a target's distribution of n-grams, with buckets from a streaming CRC ring.

A document is scanned once. At each word the ring holds the zlib states of the n-grams
that began at the last n words; each is extended by a space and the word, the word
begins a state of its own, and all states after the word are its n-grams' buckets. The
buckets are written; counts, gains and weights come from them, so texts are read once.

A bucket's gain is the floored log ratio, in thousandths, of its smoothed share among
the target's n-grams over that among all documents'. A document's weight is the sum of
its gains. Gumbel noise from a hash of its id is added, and the greatest scores are
drawn: without replacement, in proportion to the weights.

Defined results: a null, empty or wordless text has no n-grams, weight zero and a score,
but isn't drawn as it has too few words; the hash of a null doc_id is that of an empty
id, and it comes after all others among equal scores; repeated rows have equal scores and are
each drawn and ranked; other columns are ignored; an empty table gives an empty result,
and an empty target leaves the counts of the documents alone to decide.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, new_path
from quarry.llm.selection import top_k_cut

#: Words of the longest n-gram, buckets, words that a document to be drawn has at least, percent of those drawn.
LONGEST, BUCKETS, LEAST_WORDS, PERCENT = 1, 10_000, 20, 10

SEED = 2024

#: Bytes of buckets that are counted or added up at once.
HELD = 8 << 20

#: ASCII as words see it: capitals in lower case, letters and digits as they are, all else a space.
_PLAIN = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20) for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case."""
    return raw.translate(_PLAIN).split() if raw else []


def ring_hashes(words: list[bytes], longest: int = LONGEST) -> list[int]:
    """CRC-32 of every run of 1 to ``longest`` words joined by one space, in one scan."""
    crc = zlib.crc32
    if longest == 1:
        return list(map(crc, words))
    out: list[int] = []
    ring = [0] * longest  # ring[i % longest]: the state of the n-gram that began at word i
    for at, word in enumerate(words):
        grown = b" " + word
        for i in range(max(0, at - longest + 1), at):
            ring[i % longest] = crc(grown, ring[i % longest])
            out.append(ring[i % longest])
        ring[at % longest] = crc(word)
        out.append(ring[at % longest])
    return out


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def scan(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, features) for every row of ``docs`` (doc_id, text): the buckets of its n-grams, as packed integers."""
    kind, width = docs.schema["doc_id"].dataType.simpleString(), _width(buckets)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, sizes, found, held = batch.column("doc_id"), [], [], 0
            texts, at = batch.column("text").cast(pa.large_binary()), 0
            for i, raw in enumerate(texts):
                words = words_of(raw.as_py())
                hashes = ring_hashes(words, longest)
                sizes.append(len(words))
                found.append((np.fromiter(hashes, np.uint32, len(hashes)) % np.uint32(buckets)).astype(width).tobytes())
                held += len(found[-1])
                if held > HELD or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_words", "features"])
                    at, sizes, found, held = i + 1, [], [], 0

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, features binary")


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the n-grams of all rows by bucket; a task sends one row for each bucket that it met."""
    width = _width(buckets)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column("features"):
                total += np.bincount(np.frombuffer(raw.as_buffer(), width), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    return scanned.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw, target):
    """Each bucket's gain in thousandths, from its counts among all documents and in the target."""
    import math

    import numpy as np

    k, all_raw, all_target = len(raw), int(sum(raw)), int(sum(target))
    return np.array([math.floor(1000 * math.log((t + 1) * (all_raw + k) / ((s + 1) * (all_target + k)))) for s, t in zip(map(int, raw), map(int, target))], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of SHA-256 of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank``, their places from 1 on in ``order``, without gathering them in a task.

    They are dealt to ranges of the order and sorted there; a row's number within its
    range is added to the sizes of the ranges before, of which there are as many as tasks.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = checkpoint(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(sizes.select("_part", before.alias("_base")))
    own = dealt.withColumn("_part", part).join(bases, "_part")
    return own.withColumn("rank", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_base", "_at")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs``; ``rank`` is null where a row isn't drawn.

    Of the rows with ``least_words`` words or more ``percent`` percent are drawn, ties to
    the smaller doc_id. The driver holds one number for each bucket.
    """
    import numpy as np

    spark, width = docs.sparkSession, _width(buckets)
    path = new_path(spark, "features")
    scan(docs, longest, buckets).write.parquet(path)
    scanned = spark.read.parquet(path)

    def counted(rows):
        out = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(rows, buckets).collect():
            out[bucket] = n
        return out

    sent = spark.sparkContext.broadcast(gains(counted(scanned), counted(scan(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets))))

    def add(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own = [np.frombuffer(raw.as_buffer(), width) for raw in batch.column("features")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array([len(x) for x in own], pa.int64()), pa.array([int(sent.value[x].sum()) for x in own], pa.int64())],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = scanned.select("doc_id", "n_words", "features").mapInArrow(add, f"doc_id {kind}, n_words long, n_features long, weight long")
    rows = checkpoint(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.col("n_words") >= least_words
    n, low, high = rows.filter(able).agg(F.count("*"), F.min("score"), F.max("score")).first()
    k = percent * n // 100
    columns = [*rows.columns, F.lit(None).cast("long").alias("rank")]
    if not k:
        return rows.select(*columns)
    cut = top_k_cut(rows.filter(able).withColumn("_key", F.col("score").cast("double")), "_key", k, float(low), float(high))
    taken = able & (F.col("score") >= F.lit(cut))
    # The place parts rows of one id, so no id fills a range.
    placed = rows.filter(taken).withColumn("_place", F.monotonically_increasing_id())
    ranked = _ranked(placed, [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("_place")])
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return drawn.select(*rows.columns, "rank").unionByName(rows.filter(~taken).select(*columns))
