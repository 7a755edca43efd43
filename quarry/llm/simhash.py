"""SimHash near-duplicates: a Gray-order hierarchical index, distributed by pigeonhole keys.

Fingerprints that differ in at most ``DISTANCE`` bits agree on at least
``blocks - DISTANCE`` of ``blocks`` bit blocks. Each distinct fingerprint goes to
one index group for each choice of so many blocks, so any linked pair meets in
some group. Fingerprints of a group are sorted by Gray rank, in which equal leading
patterns are neighbours; such patterns are factored into the nodes of a tree of
several levels, each node holding the bits of its own level once. All candidates
come from that tree: a query carries its differences down from level to level, and
a node is left out with all below it once they exceed the distance. A group yields
a forest of links, not all its pairs, and the components come from a distributed
contraction. A group of more than LARGE members is dealt out again by its free
bits, until none is left. The result is exact at every size.

Defined results: null and blank texts have fingerprint zero and link like any
other; repeated rows get equal results; a null ``doc_id`` keeps its row and is
never chosen as ``component_id`` unless all of its component are null; further
columns are ignored, and carried unchanged by :func:`keep_one` whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, ROW_KEY, checkpoint, count_bounded, heavy_keys, join_counted, row_key, rows_in
from quarry.llm.components import connected_components

SHINGLE, SEED, DISTANCE = 4, 42, 4

#: Shingle hashes that are held at once while bits are counted.
HELD = 1 << 20

#: Distinct fingerprints a group has on average at most, before more blocks are used.
GROUP = 256

#: Members above which a group is dealt out again by the bits that its key doesn't hold.
LARGE = 20_000

#: Free bits of a key at which a group can't be large, and isn't dealt out further.
SMALL_BITS = 14

#: Leading bits that the nodes of each level of the index share.
LEVELS = (8, 16, 24, 32, 48, 64)

#: Members of a group that are looked up at once before any of it has been reached.
SEEDS = 64


def shingle_hashes(raw: bytes | None) -> list[int]:
    """XXH64 of each shingle of a text; those of fewer words are one shingle."""
    from xxhash import xxh64_intdigest as digest

    words = raw.lower().split() if raw else []
    if not words:
        return []
    flat = b" ".join(words)
    if len(words) <= SHINGLE:
        return [digest(flat, SEED)]
    starts, ends, at = [], [], 0
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    return [digest(flat[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]


def majority_bits(hashes, sizes):
    """For runs of ``sizes`` hashes: a bit is one if more than half of the run have it; an empty run gives zero.

    Eight byte-wide counters share a 64-bit word, so at most 255 hashes are summed before they are widened.
    """
    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    blocks = -(-sizes[full] // 255)
    first = np.cumsum(sizes[full]) - sizes[full]
    base = np.cumsum(blocks) - blocks
    cuts = np.repeat(first, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(base, blocks))
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, cuts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), base, axis=0)
        ones = (2 * counts > sizes[full][:, None]).astype(np.uint64)
        for lane in range(8):
            out[full] |= ones[:, lane] << np.uint64(8 * lane + k)
    return out


def _fingerprint_batches(batches):
    import numpy as np
    import pyarrow as pa

    def flush(hashes, sizes):
        return majority_bits(np.array(hashes, np.uint64), sizes)

    for batch in batches:
        found, hashes, sizes = [], [], []
        for raw in batch.column("text").cast(pa.large_binary()):
            own = shingle_hashes(raw.as_py())
            hashes += own
            sizes.append(len(own))
            if len(hashes) > HELD:
                found.append(flush(hashes, sizes))
                hashes, sizes = [], []
        found.append(flush(hashes, sizes))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp) for every row; fp is the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(_fingerprint_batches, f"doc_id {kind}, row_key {ROW_KEY}, fp long")


def gray_rank(code: Column) -> Column:
    """The place of ``code`` in Gray order: each bit is the parity of the bits from the top down to it."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def block_masks(n: int, free: int = (1 << 64) - 1, least: int = 1) -> list[int]:
    """Masks over the ``free`` bits: a pair within DISTANCE agrees under at least one of them.

    More blocks make longer keys; as many are used as keep groups near GROUP members.
    """
    bits = [b for b in range(63, -1, -1) if free >> b & 1]
    for same in range(least, 5):
        blocks = DISTANCE + same
        if n <= GROUP << (len(bits) * same // blocks) or same == 4:
            break
    part = [sum(1 << b for b in bits[i * len(bits) // blocks : (i + 1) * len(bits) // blocks]) for i in range(blocks)]
    return [sum(c) for c in combinations(part, same)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _deal(rows: DataFrame, masks: DataFrame, key: Column) -> DataFrame:
    """(key, mask, fp): each row once for every mask of ``masks`` (mask, more) that is for its own ``mask``; ``key`` is the group before."""
    found = rows.join(F.broadcast(masks), "mask")
    return found.select(F.xxhash64(key, "mask", "more", F.col("fp").bitwiseAND(F.col("more"))).alias("key"), F.col("mask").bitwiseOR(F.col("more")).alias("mask"), "fp")


#: Pairs of a query and a node that are held at once.
COMPARED = 2_000_000


class Index:
    """A tree for each group over codes in Gray order: the nodes of each level, with their patterns and where their children begin."""

    def __init__(self, groups, codes):
        import numpy as np

        self.codes, self.levels = codes, []
        new = np.concatenate([[True], groups[1:] != groups[:-1]])
        parents = np.flatnonzero(new)
        self.groups = groups[parents]
        for bits in LEVELS:
            pattern = codes >> np.uint64(64 - bits)
            new = new | np.concatenate([[True], pattern[1:] != pattern[:-1]])
            nodes = np.flatnonzero(new)
            below = np.searchsorted(nodes, np.append(parents, len(codes)))
            own = bits - (self.levels[-1][1] if self.levels else 0)
            self.levels.append((below, bits, np.uint64((1 << own) - 1), pattern[nodes]))
            parents = nodes

    def search(self, groups, queries):
        """(query, place) of all codes within DISTANCE of each query in its own group."""
        import numpy as np

        root = np.minimum(np.searchsorted(self.groups, groups), len(self.groups) - 1)
        q = np.flatnonzero(self.groups[root] == groups)
        node, carried = root[q], np.zeros(len(q), np.uint8)
        for below, bits, own, pattern in self.levels:
            many = below[node + 1] - below[node]
            child = np.repeat(below[node] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            q = np.repeat(q, many)
            differ = np.repeat(carried, many) + np.bitwise_count(((queries[q] >> np.uint64(64 - bits)) ^ pattern[child]) & own)
            near = np.flatnonzero(differ <= DISTANCE)
            q, node, carried = q[near], child[near], differ[near]
        return q, node


def group_links(keys, codes):
    """Links (a, b) that connect what is within DISTANCE in groups of equal keys.

    ``keys`` are sorted and ``codes`` distinct and in Gray order in each group. Queries
    are what has been reached, and where nothing is reached the next SEEDS codes
    of a group; targets are what hasn't been, and the queries themselves where those of
    a group aren't known to be connected. So every pair within DISTANCE is met
    when the first of its codes is looked up, or is known to be connected by then.
    What has been looked up leaves the index, so a dense group costs little more
    than its size, and links that connect nothing new are left out.
    """
    import numpy as np

    n = len(keys)
    group = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    left, reached = np.arange(n), np.zeros(0, np.int64)
    a, b = [reached], [reached]
    label, parent = np.full(n, -1), np.arange(n)  # the root of a code's label stands for all that it is known to be connected with
    while len(left) or len(reached):
        busy = np.zeros(group[-1] + 1, bool)
        busy[group[reached]] = True
        g = group[left]
        seeds = left[(np.arange(len(left)) - np.searchsorted(g, g) < SEEDS) & ~busy[g]]
        label[seeds] = seeds
        queries = np.sort(np.concatenate([reached, seeds]))
        own = parent[label[reached]]
        mixed = np.zeros(len(busy), bool)
        mixed[group[reached[own != own[np.searchsorted(group[reached], group[reached])]]]] = True
        targets = np.sort(np.concatenate([left, reached[mixed[group[reached]]]]))
        if not len(targets):
            break
        asks = np.zeros(n, bool)
        asks[queries] = True
        g = group[targets]
        index = Index(g, codes[targets])
        size = np.searchsorted(g, group[queries], "right") - np.searchsorted(g, group[queries])
        block = np.cumsum(size) // COMPARED
        fresh = [reached[:0]]
        for k in np.unique(block):
            own = queries[block == k]
            q, t = index.search(group[own], codes[own])
            q, t = own[q], targets[t]
            keep = ~asks[t] | (t > q)
            q, t = q[keep], t[keep]
            new = np.flatnonzero(label[t] < 0)
            one = new[np.unique(t[new], return_index=True)[1]]
            label[t[one]] = label[q[one]]
            fresh.append(t[one])
            a.append(q[one])
            b.append(t[one])
            while True:
                x, y = parent[label[q]], parent[label[t]]
                apart = np.flatnonzero(x != y)
                if not len(apart):
                    break
                q, t, low, high = q[apart], t[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
                order = np.lexsort((low, high))
                one = order[np.concatenate([[True], np.diff(high[order]) > 0])]
                a.append(q[one])
                b.append(t[one])
                parent[high[one]] = low[one]
                while (parent != parent[parent]).any():
                    parent = parent[parent]
        reached = np.sort(np.concatenate(fresh))
        left = left[label[left] < 0]
    return codes[np.concatenate(a)], codes[np.concatenate(b)]


def _link_batches(batches):
    import numpy as np
    import pyarrow as pa

    keys, codes = [], []

    def links(last: bool):
        nonlocal keys, codes
        k, c = np.concatenate(keys), np.concatenate(codes)
        cut = len(k) if last else int(np.searchsorted(k, k[-1]))  # the last group may go on in the next batch
        keys, codes = [k[cut:]], [c[cut:]]
        a, b = group_links(k[:cut], c[:cut].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys.append(batch.column("key").to_numpy())
        codes.append(batch.column("fp").to_numpy())
        if keys[0][0] != keys[-1][-1] and sum(map(len, keys)) > 200_000:
            yield links(False)
    if keys:
        yield links(True)


def groups(nodes: DataFrame, n: int) -> DataFrame:
    """(key, fp): the index groups, none of more than LARGE members."""
    spark = nodes.sparkSession
    table = lambda rows: spark.createDataFrame([(_signed(m), _signed(x)) for m, x in rows], "mask long, more long")
    used = [0]
    more = {0: block_masks(n)}
    rows = nodes.select(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("key"), "fp")
    done = None
    while True:
        rows = _deal(rows, table([(m, x) for m in used for x in more[m]]), F.col("key"))
        many = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("mask").alias("held")).filter((F.col("n") > LARGE) & (F.bit_count("held") < 64 - SMALL_BITS))
        many = checkpoint(many)
        if many.isEmpty():
            break
        small = F.broadcast(many.select("key")) if count_bounded(many, BROADCAST_ROWS) else None
        if small is None:
            often = F.broadcast(many.filter(heavy_keys(many)).select("key"))
            rest = rows.join(often, "key", "left_anti").join(many.select("key"), "key", "left_anti")
        else:
            rest = rows.join(small, "key", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        rows = checkpoint(join_counted(rows, many.drop("held"), "key"))
        largest = many.agg(F.max("n")).first()[0]
        used = sorted(r.held & ((1 << 64) - 1) for r in many.select("held").distinct().collect())  # at most as many as masks
        more = {m: block_masks(largest, free=~m & ((1 << 64) - 1), least=2) for m in used}
    return (rows if done is None else done.unionByName(rows)).select("key", "fp")


def links(nodes: DataFrame, n: int) -> DataFrame:
    """(a, b): links that connect all of the distinct fingerprints within DISTANCE."""
    dealt = groups(nodes, n).repartition("key").sortWithinPartitions("key", gray_rank(F.col("fp")))
    return dealt.mapInArrow(_link_batches, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp, root, component_id) for every row."""
    rows = checkpoint(fingerprints(docs))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    total = nodes.count()
    labels = checkpoint(connected_components(links(nodes.select("fp"), total)))
    linked = checkpoint(nodes.join(labels.withColumnRenamed("node", "fp"), "fp"))
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = checkpoint(
        linked.join(smallest, "root").select("fp", "root", "component_id", "n")
        .union(nodes.join(labels.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("first_id").alias("component_id"), "n"))
    )
    out = join_counted(rows, members, "fp")
    return out.select("doc_id", "row_key", "fp", "root", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the one of the smallest doc_id."""
    rows = near_duplicates(docs)
    first = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row_key").alias("key")).select("key")
    counts = rows.groupBy(F.col("row_key").alias("key")).agg(F.count("*").alias("n"))
    return rows_in(docs, checkpoint(counts.join(first, "key", "left_semi")), "left_semi", one=True)
