import re
from collections import defaultdict

import pytest

from quarry.llm.mixing import mix, take, targets
from tests.llm.fixtures import documents, empty, whole

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, weight = total - sum(capped.values()), sum(w[s] for s in free)
        goal = {s: left * w[s] / weight for s in free}
        over = [s for s in free if goal[s] > most * sizes[s] + 1e-9]
        if not over:
            return capped | goal
        capped |= {s: most * sizes[s] for s in over}


def check(rows, docs):
    own = sorted((str(d), len(WORD.findall(t or ""))) for d, t, _ in docs)
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == own
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    goal = slow_targets(sizes)
    by_id = {str(d): s for d, _, s in docs}
    largest = max((r["size"] for r in rows), default=0)
    for r in rows:
        s = by_id[str(r.doc_id)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest + 1


def test_odd_rows(spark):
    docs = [(r.doc_id, r.text, r.source) for r in documents(spark).collect()]
    check(mix(documents(spark)).collect(), docs)
    assert mix(empty(spark)).count() == 0
    blank = documents(spark, [(1, None, "a"), (2, "", None)])
    assert [(r.target, r.taken) for r in mix(blank).collect()] == [(0.0, 0)] * 2


def test_whole_table_and_reruns(spark, sf_dir):
    docs = whole(spark, sf_dir)
    first = sorted(map(tuple, mix(documents(spark, docs)).collect()))
    check(mix(documents(spark, docs)).collect(), docs)
    assert first == sorted(map(tuple, mix(documents(spark, docs).repartition(7)).collect()))


def test_smaller_budgets_are_nested(spark, sf_dir):
    docs = documents(spark, whole(spark, sf_dir))
    small, large = ({r.doc_id: r.times for r in mix(docs, budget=b).collect()} for b in (0.3, 0.8))
    assert all(small[d] <= large[d] for d in large) and sum(small.values()) < sum(large.values())


def test_caps(spark):
    rows = [("a", 1), ("b", 100), ("c", 1000), (None, 7), ("z", 0)]
    got = {r.source: r.target for r in targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert got == pytest.approx(slow_targets(dict(rows)))


def test_take_repeats_rows(spark):
    docs = documents(spark)
    got = take(docs)
    assert got.columns == docs.columns
    times = defaultdict(int)
    for r in mix(docs).collect():
        times[r.doc_id] += r.times
    assert got.count() == sum(times.values())


def test_rows_without_id_are_told_apart(spark):
    docs = [(None, f"text number {i} of many", "a") for i in range(300)] + [(7, f"more {i} words", "b") for i in range(300)] + [(i, "x " * 5, None) for i in range(100, 300)]
    rows = mix(documents(spark, docs)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    by_id = {"None": "a", "7": "b"}
    for r in rows:
        s = by_id.get(str(r.doc_id))
        taken[s] += r.taken
        target[s] = r.target
    assert all(abs(taken[s] - target[s]) <= 6 for s in target)


def test_repeated_rows_share_a_budget(spark):
    """400 equal rows of a source whose target they alone would pass: so many of them are taken as come near it."""
    docs = [(None, "ten words in a row that many rows have here", "a")] * 400 + [(i, f"other text {i} of some seven words only", "a") for i in range(600)] + [(10_000 + i, "one", "b") for i in range(5000)]
    check(mix(documents(spark, docs).repartition(5)).collect(), docs)
    rows = mix(documents(spark, docs).repartition(5)).collect()
    again = mix(documents(spark, docs).repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    kept = take(documents(spark, docs)).groupBy("source").count().collect()
    assert sorted((r.source, r["count"]) for r in kept) == sorted((s, sum(r.times for r in rows if (r.source_size > 5000) == (s == "a"))) for s in ("a", "b"))
    only = [(7, "a b c d e f g h i j", "a")] * 90 + [(8, "a b", None)] * 3 + [(9, "x " * 50, "c")] * 40
    check(mix(documents(spark, only)).collect(), only)
