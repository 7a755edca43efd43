import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import resampling as R
from tests.llm.fixtures import documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, longest, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:j]).encode()) % buckets for i in range(len(w)) for j in range(i + 1, min(i + longest, len(w)) + 1)]


def slow(docs, target, longest, buckets, percent, least, seed):
    """Rows of (doc_id, n_features, weight, score, rank) by counting n-grams one by one."""
    own = [(d, len(words(t)), features(t, longest, buckets)) for d, t in docs]
    s, t = Counter(x for _, _, f in own for x in f), Counter(x for text in target for x in features(text, longest, buckets))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for d, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def table(rows):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in rows), key=order)


def order(r):
    return r[0] is None, r[0] or 0, r[1], r[4] is None, r[4] or 0


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (3, 70_000, 50)])
def test_equals_brute_force(spark, sf_dir, longest, buckets, percent):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = slow([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], longest, buckets, percent, 20, 2024)
    assert table(R.resample(docs, target, longest, buckets, percent).collect()) == sorted(expected, key=order)


def test_ring_equals_hashes_of_joined_words():
    rng = random.Random(4)
    for longest in (1, 2, 3, 5):
        w = [rng.choice(["a", "bb", "é", "\U0001f600"]).encode() for _ in range(30)]
        expected = [zlib.crc32(b" ".join(w[max(0, j - k) : j + 1])) for j in range(30) for k in reversed(range(longest)) if j - k >= 0]
        assert R.ring_hashes(w, longest) == expected


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "HELD", 100)
    docs = documents(spark)
    target = spark.createDataFrame([(1, "the old barn near a river", 0), (2, None, 0), (3, "", 0)], "item_id long, text string, doc_id int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = slow(rows, ["the old barn near a river"], 2, 500, 60, 3, 7)
    assert table(R.resample(docs, target, 2, 500, 60, 3, 7).collect()) == sorted(expected, key=order)
    assert R.resample(empty(spark), target).count() == 0
    assert R.resample(docs, target.limit(0)).count() == len(rows)
    assert all(r.rank is None for r in R.resample(docs, target, percent=0).collect())


def test_ranks_of_ties(spark):
    """Rows of one id and text have one score; each gets a rank of its own, over many ranges."""
    docs = documents(spark, [(5, "w " * 30, "a")] * 400 + [(i, "w " * 30, "a") for i in range(100)])
    got = [r.rank for r in R.resample(docs, spark.createDataFrame([("w",)], "text string"), percent=100).collect()]
    assert sorted(got) == list(range(1, 501))


def test_draws_rows_like_the_target(spark):
    rng = random.Random(1)
    docs = documents(spark, [(i, " ".join(rng.choices(["alpha", "beta", "gamma"] if i % 10 == 0 else ["delta", "eps", "zeta"], k=40)), "a") for i in range(500)])
    got = R.resample(docs, spark.createDataFrame([("alpha beta gamma " * 20,)], "text string")).collect()
    drawn = [r.doc_id for r in got if r.rank is not None]
    assert len(drawn) == 50 and sum(d % 10 == 0 for d in drawn) >= 48
    assert np.all([r.rank is None for r in got if r.doc_id not in set(drawn)])
