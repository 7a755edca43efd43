import hashlib
import random

import numpy as np
import pytest

from quarry.llm import runs as R
from quarry.llm.registry import op11_runs, planted
from tests.llm.fixtures import documents, empty, whole


def slow_runs(words, least):
    """Every maximal stretch of each period, shortest period first; a stretch whose period isn't its smallest is left out."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p and (i, j + p) not in found:
                found[i, j + p] = p
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in found.items() if b - a >= max(least, 2 * p))


def collapsed(words, found):
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


CASES = [
    [], ["a"], ["a", "a"], list("aaaaaaaaaaaaaaa"), list("abababababababa"), list("abcabcabcabcabx"), list("xabaabaabaabaaby"), list("aabaabaaabaabaaabaab"),
    fibonacci(200), list("mississippi"), list("ab" * 20 + "c" + "ab" * 20 + "c"), ["x", *list("abcd" * 9), "y"],
]


def test_runs_equal_brute_force():
    rng = random.Random(5)
    docs = CASES + [[rng.choice("ab"[: 1 + i % 2] + "c" * (i % 3)) for _ in range(rng.randint(0, 70))] for i in range(400)]
    docs += [(rng.choices("abc", k=rng.randint(1, 9)) * 12)[: rng.randint(1, 60)] for _ in range(200)] + [[str(i) for i in range(50)]] * 2
    for least in (2, 12):
        for group in (docs, *([d] for d in docs[:40])):
            names: dict = {}
            codes = np.array([names.setdefault(w, len(names)) for d in group for w in d], np.int64)
            sizes = [len(d) for d in group]
            got = list(zip(*(x.tolist() for x in R.find_runs(codes, sizes, least))))
            base = np.cumsum([0, *sizes]).tolist()
            assert got == [(a + b, n, p) for d, b in zip(group, base) for a, n, p in slow_runs(d, least)]


def test_next_smaller_beyond_the_jumps():
    rng = random.Random(1)
    for values in ([0, *range(300, 0, -1)], list(range(100)), rng.sample(range(500), 500), [0, *range(150, 0, -1), *range(200, 150, -1)]):
        v = np.array(values)
        expected = [next((j for j in range(i + 1, len(values)) if values[j] < values[i]), len(values)) for i in range(len(values))]
        assert R.next_smaller(v).tolist() == expected


@pytest.mark.parametrize("held", [R.HELD, 300])
def test_odd_rows(spark, monkeypatch, held):
    monkeypatch.setattr(R, "HELD", held)
    rows = documents(spark).collect()
    got = R.periodic_runs(documents(spark), least=2).collect()
    assert len(got) == len(rows)
    expected = []
    for r in rows:
        words = (r.text or "").split()
        found = slow_runs(words[:400], 2) if len(words) <= 400 else []
        expected.append((r.doc_id, len(words), found, collapsed(words, found)))
    key = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(expected, key=key)
    assert R.periodic_runs(empty(spark)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    """Every column on all documents of up to 700 words, whose repetitions brute force finds in time, and the words of all."""
    got = {r.doc_id: r for r in op11_runs(spark, sf_dir).collect()}
    docs, checked = whole(spark, sf_dir), 0
    assert len(got) == len(docs)
    for doc_id, text, _ in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        n, r = len(words), got[doc_id]
        assert r.n_words == n
        if n > 700:
            continue
        if words and (own := planted(doc_id, n)):
            a, p = own
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        found = slow_runs(words, 12)
        checked += bool(found)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
    assert checked > 5
