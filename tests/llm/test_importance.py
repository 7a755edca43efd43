import math
from collections import Counter

import numpy as np
import xxhash

from quarry.llm import importance as I
from quarry.llm.selection import top_k_cut
from tests.llm.fixtures import documents, empty, whole


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def slow_buckets(text):
    """Buckets of words and of pairs of words, with plain integers of 64 bits."""
    most, bits = (1 << 64) - 1, 20
    one = [xxhash.xxh64(w, seed=11).intdigest() for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    two = [((a * 0x9E3779B97F4A7C15 & most) ^ (b >> 7)) * 0xC2B2AE3D27D4EB4F & most for a, b in zip(one, one[1:])]
    return [h >> (64 - bits) for h in one + two]


def test_weights_equal_brute_force(spark, sf_dir):
    docs = whole(spark, sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    ids = {d: slow_buckets(t) for d, t, _ in docs}
    good = {d for d, q, t in rows if q == 1 and t == 0}
    raw, target = Counter(b for x in ids.values() for b in x), Counter(b for d in good for b in ids.get(d, []))
    scale = sum(target.values()) / sum(raw.values())
    ratio = lambda b: math.log((target[b] + 5.0) / (raw[b] * scale + 5.0))
    got = {r.doc_id: r for r in I.importance(documents(spark, docs), labels(spark, rows)).collect()}
    for d, x in ids.items():
        assert got[d].log_weight == pytest_approx(sum(map(ratio, x))) and got[d].n_grams == len(x)
    k = math.ceil(len(docs) * len(good) / len(rows))
    keys = sorted((r.log_weight + r.gumbel for r in got.values()), reverse=True)
    assert {d for d, r in got.items() if r.kept} == {d for d, r in got.items() if r.log_weight + r.gumbel >= keys[k - 1]}


def pytest_approx(x):
    import pytest

    return pytest.approx(x, rel=1e-5, abs=1e-4)


def test_odd_rows(spark):
    got = I.importance(documents(spark), labels(spark, [(1, 1, 0), (1, 0, 0), (2, 1, 0), (None, 1, 0), (12, 0, 0)]), k=5).collect()
    assert len(got) == documents(spark).count() and sum(r.kept for r in got) >= 5
    assert all(r.kept for r in I.importance(documents(spark), labels(spark, [])).collect())
    assert I.importance(empty(spark), labels(spark, [(1, 1, 0)])).count() == 0


def test_top_k_cut(spark):
    values = [float(x) for x in np.random.default_rng(2).standard_normal(500)] + [1.5] * 20
    rows = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 60, 519, 520, 521):
        expected = sorted(values, reverse=True)[k - 1] if k <= len(values) else float("-inf")
        assert top_k_cut(rows, "key", k, min(values), max(values)) == expected


def test_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, own = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, held = own.filter("hash(doc_id) % 2 = 0"), own.filter("hash(doc_id) % 2 <> 0")
    rows = I.importance(docs, fit).join(held, "doc_id").collect()
    rate = lambda f: sum(r.kept for r in rows if f(r)) / sum(1 for r in rows if f(r))
    assert rate(lambda r: r.quality == 1 and not r.toxic) > 0.8
    assert rate(lambda r: r.quality == 0) < 0.35
