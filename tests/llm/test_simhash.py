import numpy as np
import pytest
import xxhash

from quarry.llm import simhash
from quarry.llm.simhash import block_masks, fingerprint_hex, group_links, keep_one, near_duplicates
from tests.llm.fixtures import documents, empty, whole


def slow_fingerprint(text):
    words = []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" "):
        words += [w] if w else []
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """doc ids with their fingerprints and the smallest id reachable, by comparing all fingerprints."""
    codes = sorted({f for _, f in rows})
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    arr = np.array(codes, np.uint64)
    for i, c in enumerate(codes):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4):
            a, b = find(c), find(codes[i + 1 + j])
            root[max(a, b)] = min(a, b)
    ids = {}
    for d, f in rows:
        ids.setdefault(find(f), []).append(d)
    return sorted((str(d), f"{f:016x}", str(min((x for x in ids[find(f)] if x is not None), default=None))) for d, f in rows)


def result(df):
    rows = df.select("doc_id", fingerprint_hex(df["fp"]).alias("f"), "component_id").collect()
    return sorted((str(r.doc_id), r.f, str(r.component_id)) for r in rows)


@pytest.mark.parametrize("data", ["odd", "whole"])
def test_equals_brute_force(spark, sf_dir, data):
    df = documents(spark) if data == "odd" else documents(spark, whole(spark, sf_dir))
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in df.collect()]
    assert result(near_duplicates(df)) == slow_components(rows)


def test_empty(spark):
    assert near_duplicates(empty(spark)).count() == 0
    assert keep_one(empty(spark)).columns == empty(spark).columns


def ball(rng, n, bits):
    center = rng.integers(0, 1 << 63, dtype=np.uint64)
    flips = rng.integers(0, 64, (n, bits))
    return center ^ np.bitwise_xor.reduce(np.uint64(1) << flips.astype(np.uint64), axis=1)


def components(codes, a, b):
    index = {int(c): i for i, c in enumerate(codes)}
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in zip(a, b):
        root[find(index[int(x)])] = find(index[int(y)])
    groups = {}
    for i in range(len(codes)):
        groups.setdefault(find(i), set()).add(int(codes[i]))
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed", range(4))
def test_search_connects_what_pairs_connect(seed):
    rng = np.random.default_rng(seed)
    codes = np.unique(np.concatenate([ball(rng, 300, 3), ball(rng, 200, 9), rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    i, j = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4, 1))
    expected = components(codes, codes[i], codes[j])
    a, b = group_links(np.zeros(len(codes), np.int64), codes)  # any order that keeps prefixes together will do
    assert components(codes, a, b) == expected
    assert len(a) <= len(codes) + 64 * 63 // 2 * (len(codes) // 64 + 1)


@pytest.mark.parametrize("bits", [18, 19, 20, 21, 22])
def test_codes_that_several_seeds_reach_connect_them(bits):
    """More codes than SEEDS in one group, whose components meet in codes that are no seeds."""
    rng = np.random.default_rng(bits)
    codes = np.unique(rng.integers(0, 1 << bits, 400).astype(np.uint64))
    codes = codes[np.argsort(gray(codes))]
    i, j = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes) <= 4, 1))
    a, b = group_links(np.zeros(len(codes), np.int64), codes)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    assert components(codes, a, b) == components(codes, codes[i], codes[j])
    assert len(a) == len(codes) - len(components(codes, a, b))


def gray(codes):
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


def dealt(codes, masks):
    """Keys and codes of all index groups, in the order that the operator deals them."""
    keys = np.concatenate([(codes & np.uint64(m)) ^ np.uint64(i * 0x9E3779B97F4A7C15 % 2**64) for i, m in enumerate(masks)])
    every = np.tile(codes, len(masks))
    order = np.lexsort((gray(every), keys))
    return keys[order], every[order]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_all_links_come_from_the_index(monkeypatch, scale):
    """Every link is one that the tree returned, every query went through it, and its upper levels left out most."""
    import pyarrow.parquet as pq

    texts = pq.read_table(f"/root/testdata/{scale}/documents.parquet", columns=["text"]).column("text").to_pylist()
    hashes = [simhash.shingle_hashes(t.encode() if t else None) for t in texts]
    codes = np.unique(simhash.majority_bits(np.array([h for x in hashes for h in x], np.uint64), [len(x) for x in hashes]))
    keys, every = dealt(codes, block_masks(len(codes)))
    returned, asked, search = set(), set(), simhash.Index.search

    def recorded(self, groups, queries):
        q, t = search(self, groups, queries)
        asked.update(queries.tolist())
        returned.update(frozenset(x) for x in zip(queries[q].tolist(), self.codes[t].tolist()))
        return q, t

    monkeypatch.setattr(simhash.Index, "search", recorded)
    a, b = group_links(keys, every)
    assert len(a) and asked == set(codes.tolist())
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist())} <= returned
    i, j = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4, 1))
    assert components(codes, a, b) == components(codes, codes[i], codes[j])
    assert {frozenset(x) for x in zip(codes[i].tolist(), codes[j].tolist())} >= {frozenset(x) for x in zip(a.tolist(), b.tolist())}


def test_tree_factors_shared_patterns_and_prunes():
    rng = np.random.default_rng(2)
    codes = np.sort(np.concatenate([ball(rng, 400, 4), rng.integers(0, 1 << 63, 1200, dtype=np.uint64)]))
    codes = np.unique(codes)
    index = simhash.Index(np.zeros(len(codes), np.int64), codes)
    nodes = [len(pattern) for _, _, _, pattern in index.levels]
    assert nodes == sorted(nodes) and nodes[0] < 300 and nodes[-1] == len(codes)
    q, t = index.search(np.zeros(len(codes), np.int64), codes)
    assert sorted(zip(q.tolist(), t.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4))))


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**11])
def test_masks_miss_no_pair(n):
    rng = np.random.default_rng(1)
    masks = [m & ((1 << 64) - 1) for m in block_masks(n)]
    for _ in range(500):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not diff & m for m in masks)


def test_large_groups_are_dealt_out_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 20)
    rng = np.random.default_rng(5)
    codes = np.unique(np.concatenate([ball(rng, 200, 4), ball(rng, 100, 12), rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    nodes = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    got = simhash.links(nodes, len(codes)).toPandas()
    i, j = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4, 1))
    assert components(codes, got.a.to_numpy().view(np.uint64), got.b.to_numpy().view(np.uint64)) == components(codes, codes[i], codes[j])


def test_keep_one(spark):
    kept = keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    expected = {}
    for d, _, c in result(near_duplicates(documents(spark))):
        expected[c] = True
    assert ids == sorted(expected)


def test_keep_one_carries_clashing_columns_unchanged(spark):
    docs = documents(spark)
    kept = keep_one(docs)
    assert kept.dtypes == docs.dtypes
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}


def test_keep_one_of_a_row_that_a_third_of_all_rows_repeat(spark):
    docs = documents(spark, [(7, "the same text in many rows", "a")] * 500 + [(i, f"a {i * 7919} b {i * 104729} c {i}", "b") for i in range(1000, 2000)])
    kept = keep_one(docs).collect()
    assert sum(r.doc_id == 7 for r in kept) == 1 and len(kept) == len({r.doc_id for r in kept})
