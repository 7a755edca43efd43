import numpy as np
import pandas as pd
import pytest

from quarry.llm import near_copies as N
from tests.llm.fixtures import PROSE, documents, empty, whole


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_pairs(sets):
    """All pairs of different sets of similarity 0.8 or more, by their shared shingles."""
    places = {}
    for i, s in enumerate(sets):
        for x in s:
            places.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in places[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                yield i, j


def slow_groups(texts):
    """The group of each text, and the near pairs of different sets."""
    sets = list({frozenset(shingles(t)) for t in texts})
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs = list(near_pairs(sets))
    for i, j in pairs:
        root[find(j)] = find(i)
    of = {s: find(i) for i, s in enumerate(sets)}
    return [of[frozenset(shingles(t))] for t in texts], [(sets[i], sets[j]) for i, j in pairs]


def partition(ids, groups):
    out = {}
    for i, g in zip(ids, groups):
        out.setdefault(g, []).append(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_groups_equal_brute_force(spark, scale):
    rows = whole(spark, f"/root/testdata/{scale}")
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    expected, pairs = slow_groups(texts)
    got = {r.doc_id: r.root for r in N.near_copies(documents(spark, rows)).collect()}
    assert partition(ids, [got[i] for i in ids]) == partition(ids, expected) and pairs


def family(rng, n, size, changes):
    base = [f"w{rng.integers(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[rng.integers(size)] = f"x{rng.integers(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("paired", [64, 3])
def test_large_families_and_clean_texts(spark, monkeypatch, paired):
    """A family of hundreds of near copies is one group, whether its keys are paired or met by centres; others are left alone."""
    monkeypatch.setattr(N, "PAIRED", paired)
    rng = np.random.default_rng(1)
    texts = family(rng, 150, 200, 1) + family(rng, 40, 60, 0) + [" ".join(f"c{rng.integers(10**9)}" for _ in range(80)) for _ in range(60)] + family(rng, 2, 120, 2)
    ids = list(range(len(texts)))
    got = {r.doc_id: r.root for r in N.near_copies(documents(spark, [(i, t, "a") for i, t in zip(ids, texts)])).collect()}
    assert partition(ids, [got[i] for i in ids]) == partition(ids, slow_groups(texts)[0])


@pytest.mark.parametrize("rare", [50, 3])
def test_blocks_leave_out_no_pair(monkeypatch, rare):
    """Nodes of large keys that no centre is near: every near pair of different groups, by rare and by frequent shingles."""
    monkeypatch.setattr(N, "RARE", rare)
    rng = np.random.default_rng(1)
    base, sets = rng.integers(0, 1 << 60, 100), []
    for _ in range(300):
        own = base.copy()
        changed = rng.integers(0, 100, rng.integers(5, 25))
        own[changed] = rng.integers(0, 400, len(changed))
        sets.append(np.unique(own))
    roots = rng.integers(0, 100, 300)
    got = N._block_links(pd.DataFrame({"node": range(300), "root": roots, "shingles": sets}))
    near = {(i, j) for i in range(300) for j in range(i + 1, 300) if roots[i] != roots[j] and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert near and set(zip(got["a"], got["b"])) == near


def test_odd_rows(spark):
    docs = documents(spark)
    rows, got = docs.collect(), N.near_copies(docs).collect()
    groups = partition([r.doc_id or 0 for r in got], [r.root for r in got])
    assert groups == partition([r.doc_id or 0 for r in rows], slow_groups([r.text for r in rows])[0])
    kept = N.keep_one(docs)
    assert kept.dtypes == docs.dtypes and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in rows}
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(min((i for i in g if i), default=0) for g in groups)  # 0 stands for null
    only_null = documents(spark, [(None, PROSE, "a"), (None, PROSE, "a"), (3, PROSE, "b")])
    assert [r.doc_id for r in N.keep_one(only_null).collect()] == [3]
    assert N.keep_one(empty(spark)).count() == 0


def test_band_keys_find_pairs_at_the_bound():
    """Of pairs at 0.8, candidates by bands alone, nearly all share a key; at 0.3 few do."""
    rng = np.random.default_rng(3)
    factors, share = N._factors(), {}
    for similarity in (0.8, 0.3):
        hits = 0
        for _ in range(300):
            m = 200
            both = rng.integers(0, 1 << 63, int(2 * m * similarity / (1 + similarity)), dtype=np.uint64)
            own = [np.concatenate([both, rng.integers(0, 1 << 63, m - len(both), dtype=np.uint64)]) for _ in range(2)]
            hits += bool(set(N.band_keys(own[0], factors).tolist()) & set(N.band_keys(own[1], factors).tolist()))
        share[similarity] = hits / 300
    assert share[0.8] > 0.98 and share[0.3] < 0.2


def test_a_batch_is_sketched_in_parts():
    """What a task holds in Python doesn't grow with an Arrow batch, and the rows are the same in whatever batches."""
    import pyarrow as pa

    from quarry.llm import near_copies

    texts = [None, "", "a b", *(" ".join(f"w{(i * k) % 97}" for k in range(i % 40)) for i in range(1000))]
    keys = pa.array([{"a": i, "b": i} for i in range(len(texts))])
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), keys, pa.array(texts)], ["doc_id", "row_key", "text"])
    parts = list(near_copies._sketches([whole]))
    single = list(near_copies._sketches(whole.slice(i, 1) for i in range(len(whole))))
    assert max(map(len, parts)) <= near_copies.TEXTS < len(whole)
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches(single).to_pylist()
    sets = [whole.select(["text"]).append_column("node", pa.array(range(len(texts))))]
    assert max(map(len, near_copies._sets(sets))) <= near_copies.TEXTS
