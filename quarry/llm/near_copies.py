"""Near copies of documents: five-word shingles of Jaccard similarity 0.8 or more, checked exactly.

Fingerprints within four bits, as operator 6 finds them, miss most pairs of that
similarity: they are some eight bits apart. So candidates come from those links and
from band keys of the shingles' minima, of which a pair at 0.8 shares one with probability 0.998,
and each candidate is checked on its whole shingle sets. The links that hold are
contracted to groups.

Rows of equal shingle sets are one node. First each node is paired with one node of each
of its band keys, which joins most families, and the links that hold are contracted. Then
nodes of a band key that aren't in one group yet are all paired where there are at most
PAIRED of them; in a larger key those outside its largest group are paired with CENTRES
nodes of that group. After these links are contracted too, nodes of larger keys that still
aren't in one group are compared in blocks, each with all blocks of sizes that can be near.
So no pair of a key is left out, and a family that is joined by then has none.

Defined results: texts of fewer than five words have one shingle, the whole sequence;
texts without words have none and are copies of each other; A-Z count as lower case;
a null doc_id is never first in a group unless all of its ids are null; repeated rows
are in one group; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, ROW_KEY, checkpoint, count_bounded, join_counted, look_up, new_path, row_key, rows_in
from quarry.llm.components import connected_components
from quarry.llm.simhash import links, majority_bits, shingle_hashes

SHINGLE = 5

#: A pair is near if shared * OF >= PART * all.
PART, OF = 4, 5

BANDS, BAND_ROWS = 16, 5

#: Nodes of a band key up to which all are paired; nodes of a larger key's largest group that the others meet first.
PAIRED, CENTRES = 64, 4

#: Nodes of a block, two of which a task compares; nodes of a shingle up to which its pairs are counted one by one.
BLOCK, RARE = 2000, 50

#: A node in over so small a part of all pairs counts as common.
COMMON = 200

#: Words whose hashes a worker keeps, hashes of a few texts that it holds, and texts of a batch that it has in Python at once.
CACHED, HASHES, TEXTS = 100_000, 1 << 17, 256

#: Shingles whose minima are taken at once.
CHUNK = 4096


def shingle_set(words: list[bytes], known: dict):
    """The sorted different hashes of a text's shingles."""
    import numpy as np
    import xxhash

    if len(known) > CACHED:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, 7)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(codes):
        return codes
    width = min(SHINGLE, len(codes))
    n = len(codes) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def _factors():
    import numpy as np

    rng = np.random.default_rng(2024)
    return rng.integers(1, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles, factors):
    """A key for each band: a hash of BAND_ROWS minima of the shingles under different mixings."""
    import numpy as np

    a, b = factors
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        mixed = shingles[at : at + CHUNK, None] * a
        mixed ^= mixed >> np.uint64(31)
        least = np.minimum(least, (mixed * b).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys


def _few(batches):
    """Arrow batches in slices of TEXTS rows, so that what a task makes of them in Python doesn't grow with a batch."""
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            yield batch.slice(at, TEXTS)


def _sketches(batches):
    import numpy as np
    import pyarrow as pa
    import xxhash

    factors, known = _factors(), {}
    for batch in _few(batches):
        nodes, sizes, fps, bands, hashes, runs = [], [], [], [], [], []
        for raw in batch.column("text").cast(pa.large_binary()):
            raw = raw.as_py()
            shingles = shingle_set(raw.lower().split() if raw else [], known)
            own = shingle_hashes(raw)
            nodes.append(xxhash.xxh64_intdigest(shingles.tobytes(), 3))
            sizes.append(len(shingles))
            bands.append(band_keys(shingles, factors).view(np.int64) if len(shingles) else [])
            hashes += own
            runs.append(len(own))
            if len(hashes) > HASHES:
                fps.append(majority_bits(np.array(hashes, np.uint64), runs))
                hashes, runs = [], []
        fps = np.concatenate([*fps, majority_bits(np.array(hashes, np.uint64), runs)])
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), signed(nodes), pa.array(sizes, pa.int64()), signed(fps), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "row_key", "node", "size", "fp", "bands"],
        )


def _sets(batches):
    import numpy as np
    import pyarrow as pa

    known: dict = {}
    for batch in _few(batches):
        found = [shingle_set((raw.as_py() or b"").lower().split(), known).view(np.int64) for raw in batch.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])


def _pair(x, y):
    return F.struct(x["node"].alias("a"), x["size"].alias("m"), y["node"].alias("b"), y["size"].alias("n"))


def _members(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("bands").alias("key"), F.struct("node", "size", "root").alias("x"))


def _star_pairs(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(p): each node with one node of each band key that it shares; the same one of a family for all its keys."""
    members = _members(nodes)
    heads = members.groupBy("key").agg(F.min_by("x", F.xxhash64("x.node")).alias("c"))
    return join_counted(members, checkpoint(sizes.join(heads, "key")), "key").select(_pair(F.col("x"), F.col("c")).alias("p"))


def _apart(x, y):
    """Whether nodes are in different groups and of sizes that can be near."""
    return (x["root"] != y["root"]) & (F.least(x["size"], y["size"]) * OF >= F.greatest(x["size"], y["size"]) * PART)


def _mixed_keys(members: DataFrame) -> DataFrame:
    """(key, n, most): the band keys of nodes in different groups, with their nodes and most frequent ``root``."""
    by_root = members.groupBy("key", F.col("x.root").alias("root")).agg(F.count("*").alias("n"))
    found = by_root.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("root", "n").alias("most"), F.count("*").alias("roots"))
    return checkpoint(found.filter("roots > 1").drop("roots"))


def _other_pairs(nodes: DataFrame) -> DataFrame:
    """(p): pairs of nodes of different groups (``root``) that share a band key: all of a small key; of a large one those of CENTRES nodes."""
    members = _members(nodes)
    mixed = _mixed_keys(members)
    few = join_counted(members, mixed.filter(F.col("n") <= PAIRED).drop("most"), "key").groupBy("key").agg(F.collect_list("x").alias("l"))
    of = lambda x, i: F.transform(F.filter(F.slice("l", i + 2, F.size("l")), lambda y: _apart(x, y)), lambda y: _pair(x, y))
    small = few.select(F.explode(F.flatten(F.transform("l", of))).alias("p"))
    large = mixed.filter(F.col("n") > PAIRED)
    if large.isEmpty():
        return small
    own = checkpoint(join_counted(members, large.withColumn("rows", F.col("n")), "key"))
    drawn = own.filter("x.root = most").groupBy("key").agg(F.max("rows").alias("n"), F.array(*(F.min_by("x", F.xxhash64("x.node", F.lit(i))) for i in range(CENTRES))).alias("centres"))
    met = join_counted(own.filter("x.root <> most"), checkpoint(drawn), "key").select("x", F.explode("centres").alias("c"))
    return small.unionByName(met.filter(_apart(F.col("x"), F.col("c"))).select(_pair(F.col("x"), F.col("c")).alias("p")))


def _block_links(pdf):
    """(a, b) of the near pairs of different groups among the nodes of two blocks (node, root, shingles)."""
    import numpy as np
    import pandas as pd

    n = len(pdf)
    sizes = pdf["shingles"].map(len).to_numpy()
    _, code, often = np.unique(np.concatenate([*pdf["shingles"]]), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    code, row = code[order], np.repeat(np.arange(n), sizes)[order]
    shared = np.zeros((n, n), np.float32)
    few = often[code] <= RARE
    rare, at = code[few], row[few]
    for d in range(1, RARE):
        same = np.flatnonzero(rare[d:] == rare[:-d])
        np.add.at(shared, (at[same], at[same + d]), 1)  # rows of a shingle are in order, so these are above the diagonal
    _, common = np.unique(code[~few], return_inverse=True)
    at = row[~few]
    for c in range(0, int(common.max(initial=-1)) + 1, 1024):
        own = slice(*np.searchsorted(common, (c, c + 1024)))
        part = np.zeros((n, 1024), np.float32)
        part[at[own], common[own] - c] = 1
        shared += part @ part.T
    roots, node = pdf["root"].to_numpy(), pdf["node"].to_numpy()
    found = [[], []]
    for i in range(n):
        s = shared[i, i + 1 :]
        j = i + 1 + np.flatnonzero((s * OF >= (sizes[i] + sizes[i + 1 :] - s) * PART) & (roots[i + 1 :] != roots[i]))
        found[0].append(np.full(len(j), node[i]))
        found[1].append(node[j])
    return pd.DataFrame({"a": np.concatenate(found[0]), "b": np.concatenate(found[1])})


def _last_links(nodes: DataFrame, keyed: DataFrame) -> DataFrame | None:
    """(a, b): all near pairs of different groups among the nodes of large band keys; None where each key is one group.

    Nodes of near sizes are in the same or the next bucket of sizes; a bucket is dealt to blocks of about BLOCK nodes.
    """
    members = _members(nodes)
    large = _mixed_keys(members).filter(F.col("n") > PAIRED).drop("most")
    if large.isEmpty():
        return None
    own = checkpoint(join_counted(members, large, "key").select("x.*").distinct())
    sets = _shingle_sets(own.select("node"), nodes, keyed)
    bucket = F.floor(F.log("size") / F.log(F.lit(OF / PART + 1e-4)))
    parts = checkpoint(own.groupBy(bucket.alias("bucket")).agg(F.ceil(F.count("*") / BLOCK).alias("parts")))
    rows = own.withColumn("bucket", bucket).join(F.broadcast(parts), "bucket").withColumn("block", F.struct("bucket", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")))
    blocks = parts.select(F.col("bucket").alias("near"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    blocks = F.broadcast(blocks.select("near", F.struct(F.col("near").alias("bucket"), "part").alias("other")))  # a row a block
    dealt = rows.join(sets, "node").join(blocks, F.abs(F.col("bucket") - F.col("near")) <= 1)
    dealt = dealt.select("node", "root", "shingles", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return checkpoint(dealt.groupBy("x", "y").applyInPandas(_block_links, "a long, b long"))


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(p): candidate pairs of nodes with equal fingerprints, and of the first nodes of fingerprints that operator 6 links."""
    heads = checkpoint(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("x")))
    equal = look_up(nodes.select("fp", F.struct("node", "size").alias("y")), heads, "fp").select(_pair(F.col("x"), F.col("y")).alias("p"))
    found = checkpoint(links(heads.select("fp"), heads.count()))
    a, b = heads.select(F.col("fp").alias("a"), "x"), heads.select(F.col("fp").alias("b"), F.col("x").alias("y"))
    return equal.unionByName(look_up(look_up(found, a, "a"), b, "b").select(_pair(F.col("x"), F.col("y")).alias("p")))


def _with_sets(pairs: DataFrame, sets: DataFrame, key: str, into: str) -> DataFrame:
    """``pairs`` with the shingle set of node ``key``. Sets of nodes in over a part in COMMON of the pairs, fewer than that many, are broadcast; the others are shuffled."""
    counts = checkpoint(pairs.groupBy(key).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(counts.filter(F.col("n") > total // COMMON).select(key))
    own = sets.select(F.col("node").alias(key), F.col("shingles").alias(into))
    rest = pairs.join(often, key, "left_anti").join(own.hint("merge"), key)
    return pairs.join(F.broadcast(own.join(often, key)), key).unionByName(rest)


def _shingle_sets(own: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes of ``own`` (node), each there once."""
    needed = checkpoint(own.join(nodes.select("node", F.col("first").alias("row_key")), "node"))
    if count_bounded(needed, BROADCAST_ROWS):
        needed = F.broadcast(needed)
    texts = keyed.select("row_key", "text").join(needed, "row_key").select("node", "text")
    return checkpoint(texts.mapInArrow(_sets, "node long, shingles array<bigint>").groupBy("node").agg(F.min("shingles").alias("shingles")))


def _near(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """(a, b): those of the candidate pairs (p) whose shingle sets are near, each once."""
    pairs = pairs.select("p.*").filter("a <> b")
    pairs = pairs.filter(F.least("m", "n") * OF >= F.greatest("m", "n") * PART)  # no pair of other sizes can be near
    pairs = checkpoint(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = _shingle_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, keyed)
    met = _with_sets(_with_sets(pairs, sets, "a", "s"), sets, "b", "t")
    found = met.select("a", "b", F.size(F.array_intersect("s", "t")).alias("shared"), (F.size("s") + F.size("t")).alias("both"))
    return checkpoint(found.filter(F.col("shared") * OF >= (F.col("both") - F.col("shared")) * PART).select("a", "b"))


def _contracted(edges: DataFrame) -> DataFrame:
    """(node, root) of the components of ``edges`` (a, b), as a stored table: what Spark infers of a checkpoint's columns grows with each contraction of another's."""
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "roots")
    edges.write.parquet(f"{path}/edges")
    roots = connected_components(spark.read.schema("a long, b long").parquet(f"{path}/edges"))
    roots.write.parquet(f"{path}/found")
    return spark.read.schema("node long, root long").parquet(f"{path}/found")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, node, root) for every row of ``docs`` (doc_id, text): rows of equal root are a group of near copies."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", row_key().alias("row_key"), "text")
    rows = checkpoint(keyed.mapInArrow(_sketches, f"doc_id {kind}, row_key {ROW_KEY}, node long, size long, fp long, bands array<bigint>"))
    nodes = rows.groupBy("node").agg(F.min("row_key").alias("first"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
    nodes = checkpoint(nodes.withColumn("root", F.col("node")))
    sizes = checkpoint(nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    first = _near(_star_pairs(nodes, sizes).unionByName(_fingerprint_pairs(nodes)), nodes, keyed)
    grouped = lambda: checkpoint(look_up(nodes.drop("root"), roots, "node").withColumn("root", F.coalesce("root", "node")))
    roots = _contracted(first)
    roots = _contracted(roots.toDF("a", "b").union(_near(_other_pairs(grouped()), nodes, keyed)))
    last = _last_links(grouped(), keyed)
    if last is not None:
        roots = _contracted(roots.toDF("a", "b").union(last))
    return look_up(rows.select("doc_id", "row_key", "node"), roots, "node").select("doc_id", "row_key", "node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but one of each group: the one of the smallest doc_id."""
    rows = checkpoint(near_copies(docs))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("x")).select(F.col("x.row_key").alias("key"))
    counts = rows.groupBy(F.col("row_key").alias("key")).agg(F.count("*").alias("n"))
    return rows_in(docs, checkpoint(counts.join(first, "key", "left_semi")), "left_semi", one=True)
