import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quarry.operators import align

TERMS = "code long, display string, parent_code long, pos long, embedding array<double>"


def tree(spark, rows):
    return spark.createDataFrame([(c, str(c), p, pos, v) for c, p, pos, v in rows], TERMS)


def slow_descend(q, rows, limit=100):
    kids = {}
    for c, p, pos, v in sorted(rows, key=lambda r: (r[2], r[0])):
        kids.setdefault(p, []).append((c, pos, v))
    score = lambda v: sum(a * b for a, b in zip(q, v))
    best = lambda xs: max((score(v), -pos, c) for c, pos, v in xs)
    s, _, code = best(kids[None])
    steps = 0
    while code in kids and (x := best(kids[code][:limit]))[0] > s:
        s, code, steps = x[0], x[2], steps + 1
    return code, round(s, 9), steps


def chain(depth):
    return [(0, None, 0, [1.0, 0.0])] + [(i, i - 1, i, [1.0 + i, 0.0]) for i in range(1, depth)]


def test_a_chain_of_a_hundred_levels(spark, monkeypatch):
    terms = tree(spark, chain(100))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, None)], "k long, embedding array<double>")
    assert align.descendants(tree(spark, chain(40)), limit=None).count() == 39 * 40 // 2
    got = sorted((r.k, -1 if r.code is None else r.code, r.steps, r.accepted) for r in align.descend(q, terms, "k").collect())
    assert got == [(1, 0, 0, False), (1, 99, 99, True), (2, -1, 0, False)]
    monkeypatch.setattr(align, "HIERARCHY_ROWS", 5)
    terms = tree(spark, chain(12))  # level by level; partitions don't add up
    got = sorted((r.k, -1 if r.code is None else r.code, r.steps) for r in align.descend(q, terms, "k").collect())
    assert got == [(1, 0, 0), (1, 11, 11), (2, -1, 0)]


@pytest.mark.parametrize("bound", [50_000, 20])
def test_descent_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(align, "HIERARCHY_ROWS", bound)
    rng = random.Random(bound)
    vector = lambda: [rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(4)]  # noqa: E731  (many ties)
    rows = [(i, None if i < 5 else rng.randrange(i), rng.randrange(40), vector()) for i in range(300)]
    queries = [(i % 50, vector()) for i in range(120)]
    got = align.descend(spark.createDataFrame(queries, "k long, embedding array<double>"), tree(spark, rows), "k").collect()
    assert sorted((r.k, r.code, round(r.score, 9), r.steps) for r in got) == sorted((k, *slow_descend(v, rows)) for k, v in queries)


@pytest.mark.parametrize("block", [20_000, 700])
def test_nearest_of_five_thousand_candidates(spark, monkeypatch, block):
    monkeypatch.setattr(align, "CANDIDATES", block)
    monkeypatch.setattr(align, "BALL_ROWS", 10)
    monkeypatch.setattr(align, "ASKED_ROWS", 15)
    rng = random.Random(4)
    vector = lambda: [rng.choice((-1.0, 0.0, 1.0)) for _ in range(5)]
    rows = [(i, None, rng.randrange(100), vector()) for i in range(5000)]
    queries = [(i, vector()) for i in range(40)] + [(100, None), (101, [])]
    got = {r.k: (r.code, r.score) for r in align.nearest(spark.createDataFrame(queries, "k long, embedding array<double>"), tree(spark, rows)).collect()}
    for k, v in queries:
        expected = max(((sum(a * b for a, b in zip(v, w)), -pos, c) for c, _, pos, w in rows)) if v else None
        assert got[k] == ((expected[2], expected[0]) if expected else (None, None))


def test_no_candidates(spark):
    got = align.nearest(spark.createDataFrame([(1, [1.0])], "k long, embedding array<double>"), tree(spark, [])).collect()
    assert [(r.k, r.code, r.score) for r in got] == [(1, None, None)]


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        align.descendants(tree(spark, [(1, 2, 0, [1.0]), (2, 1, 0, [1.0])]))


def test_a_walk_has_no_shuffle_after_the_hierarchy_is_read(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "k long, embedding array<double>")
    plan = align.descend(q, tree(spark, chain(30)), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and len(plan.splitlines()) < 40


def test_miss_then_descent_then_tristate(spark):
    verified = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [0.0, 0.1])], "k long, found int, embedding array<double>")
    accepted = align.semantic_matches(verified, tree(spark, chain(3)), "k", threshold=2.0)
    assert {(r.k, r.semantic) for r in align.tri_state(verified, accepted, "k").collect()} == {(1, "n/a"), (2, "1"), (3, "0")}


def slow_nearest_descendants(rows, limit):
    kids = {}
    for c, p, pos, _ in rows:
        kids.setdefault(p, []).append((pos, c))
    out = []
    for a in {r[0] for r in rows}:
        level, found, depth = [a], [], 0
        while level:
            depth += 1
            below = sorted(x for c in level for x in kids.get(c, []))
            found += [(a, c, depth) for _, c in below]
            level = [c for _, c in below]
        out += found[:limit]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [100_000, 3])
@pytest.mark.parametrize("limit", [1, 2, 7, 50])
def test_nearest_descendants_equal_brute_force(spark, monkeypatch, limit, broadcast):
    monkeypatch.setattr(align, "BROADCAST_ROWS", broadcast)
    rng = random.Random(limit)
    rows = [(i, None if i < 3 else rng.randrange(max(0, i - 30), i), rng.randrange(6), [1.0]) for i in range(250)]
    got = align.descendants(tree(spark, rows), limit).select("ancestor", "code", "depth").collect()
    assert sorted(map(tuple, got)) == slow_nearest_descendants(rows, limit)


def test_a_limit_bounds_the_rows_of_every_level(spark, monkeypatch):
    """A chain of 61 with limit 2 takes two levels and builds what it keeps, not all pairs."""
    built, plain = [], align.checkpoint
    monkeypatch.setattr(align, "checkpoint", lambda df: (built.append((df.columns, (out := plain(df)).count())), out)[1])
    assert align.descendants(tree(spark, chain(61)), 2).count() == 119
    levels = [n for c, n in built if "depth" in c]
    assert levels == [60, 59, 0] or levels == [60, 59]
    built.clear()
    bush = [(0, None, 0, [1.0])] + [(i, (i - 1) // 3, i, [1.0]) for i in range(1, 400)]
    align.descendants(tree(spark, bush), 5)
    assert all(n <= 5 * 400 for c, n in built if "depth" in c)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 12))
    v = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 12)) * 0.05
    q = centres[:50] + rng.normal(size=(50, 12)) * 0.05
    found, made = align.best_in_ball(q, [-np.inf] * 50, list(range(6000)), [0] * 6000, v)
    assert [c for _, _, c in found] == (q @ v.T).argmax(axis=1).tolist()
    assert made < 50 * 6000 / 3
    least = (q @ v.T).max(axis=1)
    assert align.best_in_ball(q, least + 0.1, list(range(6000)), [0] * 6000, v)[0] == [None] * 50


def test_a_hundred_thousand_candidates_without_a_driver_copy(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(6)
    n, dim = 100_000, 16
    centres = rng.normal(size=(500, dim))
    v = centres[rng.integers(0, 500, n)] + rng.normal(size=(n, dim)) * 0.1
    v[: n // 3] = v[0]  # a third are equal
    q = centres[rng.integers(0, 500, 300)] + rng.normal(size=(300, dim)) * 0.1
    lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, dim, dtype=np.int32), m.ravel())
    pq.write_table(pa.table({"code": np.arange(n), "pos": np.arange(n) % 7, "embedding": lists(v)}), f"{tmp_path}/c.parquet")
    pq.write_table(pa.table({"k": np.arange(300), "embedding": lists(q)}), f"{tmp_path}/q.parquet")
    count = spark.sparkContext.accumulator(0)
    rows = lambda x: spark.read.parquet(f"{tmp_path}/{x}.parquet").repartition(4)
    got = {r.k: (r.code, r.score) for r in align.nearest(rows("q"), rows("c"), comparisons=count).collect()}
    scores = q @ v.T
    for i in range(300):
        near = np.flatnonzero(scores[i] >= scores[i].max() - 1e-9)
        assert got[i][0] == max(near.tolist(), key=lambda j: (-(j % 7), j)) and abs(got[i][1] - scores[i].max()) < 1e-9
    assert 0 < count.value < 300 * n / 10, count.value


def test_tiles_find_the_exact_best_with_ties():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(9000, 24)) * rng.choice([1e-3, 1.0, 50.0], 9000)[:, None]
    v[4500:4600] = v[:100]
    q = np.concatenate([rng.normal(size=(300, 24)), np.zeros((2, 24)), v[:40]])
    places, codes = [j % 7 for j in range(9000)], [f"c{j}" for j in range(9000)]
    rows, scores, found, _ = align.best_in_tile(q, np.full(len(q), -np.inf), codes, places, v)
    assert rows.tolist() == list(range(len(q)))
    for i, s, j in zip(rows, scores, found):
        exact = align.products(np.repeat(q[i : i + 1], 9000, axis=0), v)
        assert s == exact.max() == align._exact(q[i], v[j])
        assert j == max(np.flatnonzero(exact == s).tolist(), key=lambda j: (-places[j], codes[j]))
    rows, _, again, _ = align.best_in_tile(q, scores, codes, places, v)
    assert rows.tolist() == list(range(len(q))) and (again == found).all()
    assert not len(align.best_in_tile(q, scores + 1e-6 + abs(scores) * 1e-6, codes, places, v)[0])


def test_rows_that_no_bound_helps_are_not_copied_for_each_ball(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    v, q = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(4000, 64)), rng.normal(size=(200, 64))))
    lists = lambda m: pa.array(list(m), pa.list_(pa.float64()))
    pq.write_table(pa.table({"code": np.arange(4000), "pos": np.arange(4000), "embedding": lists(v)}), f"{tmp_path}/c.parquet")
    pq.write_table(pa.table({"k": np.arange(200), "embedding": lists(q)}), f"{tmp_path}/q.parquet")
    most, kept = [0], align.checkpoint

    def counted(df):
        out = kept(df)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(align, "checkpoint", counted)
    monkeypatch.setattr(align, "BALL_ROWS", 40)
    monkeypatch.setattr(align, "TILE_ROWS", 1500)
    found = align.nearest_in_balls(spark.read.parquet(f"{tmp_path}/q.parquet"), spark.read.parquet(f"{tmp_path}/c.parquet"))
    got = {r.k: r.code for r in found.collect()}
    assert got == dict(enumerate((q @ v.T).argmax(axis=1).tolist()))
    assert most[0] <= 4000, most[0]  # a row for each ball would be some 20,000
