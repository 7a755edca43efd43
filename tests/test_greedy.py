import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import cells, dedup
from quarry.scale import shared_dir

SCHEMA = "grp string, seq long, v array<double>, _g string"


def slow(rows, threshold):
    kept = {}
    for g, seq, v, x in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        own = kept.setdefault(g, [])
        if v is None or not any(w and sum(a * b for a, b in zip(v, w)) > threshold for _, w in own):
            own.append((seq, v))
    return sorted((str(g), seq) for g, x in kept.items() for seq, _ in x)


@pytest.mark.parametrize("most", [20_000, 25])
def test_rounds_keep_what_one_scan_keeps(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "GROUP_ROWS", most)
    rng = random.Random(7)
    rows = []
    for g, n in (("a", 150), ("b", 20), (None, 40)):
        for i in range(n):
            x = [rng.choice((-1.0, 0.0, 1.0)) for _ in range(3)]
            rows.append((g, i, None if rng.random() < 0.05 else x, "clash"))
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("_g", "other")
    got = dedup.greedy_keep(df, "grp", "seq", "v", 1.5)
    assert got.dtypes == df.dtypes
    assert sorted((str(r.grp), r.seq) for r in got.collect()) == slow(rows, 1.5)
    assert dedup.greedy_keep(df.limit(0), "grp", "seq", "v", 1.5).count() == 0


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def one_scan(vectors, threshold):
    """Numbers of the rows that a scan keeps, row by row."""
    held, kept = np.empty_like(vectors), []
    for i, v in enumerate(vectors):
        if not (held[: len(kept)] @ v > threshold).any():
            held[len(kept)] = v
            kept.append(i)
    return kept


def table(spark, vectors):
    rows = pa.table({"seq": np.arange(len(vectors)), "v": pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32), vectors.ravel())})
    return spark.createDataFrame(rows).withColumn("grp", F.lit("a"))


@pytest.mark.parametrize("shape", ["clusters", "chains", "unlike", "one dense cluster", "copies"])
def test_cells_keep_what_one_scan_keeps(spark, monkeypatch, shape):
    """Groups of many cells whose chains of near rows cross from cell to cell."""
    monkeypatch.setattr(dedup, "GROUP_ROWS", 150)
    monkeypatch.setattr(dedup, "CELL_ROWS", 30)
    monkeypatch.setattr(cells, "MOVED", 1)
    rng = np.random.default_rng(len(shape))
    n = 900
    if shape == "clusters":
        v = unit(unit(rng.normal(size=(40, 8)))[rng.integers(0, 40, n)] + rng.normal(size=(n, 8)) * 0.15)
    elif shape == "chains":
        a = rng.permutation(np.linspace(0, 6 * np.pi, n)) / 3
        v = np.stack([np.cos(a), np.sin(a), np.zeros(n)], axis=1)
    elif shape == "unlike":
        v = unit(rng.normal(size=(n, 24)))
    elif shape == "one dense cluster":
        v = unit(np.concatenate([np.ones((600, 5)) + rng.normal(size=(600, 5)) * 0.2, rng.normal(size=(300, 5))]))[rng.permutation(n)]
    else:
        v = unit(rng.normal(size=(20, 6)))[rng.integers(0, 20, n)]
    for threshold in (0.6, 0.97):
        got = dedup.greedy_keep(table(spark, v), "grp", "seq", "v", threshold).collect()
        assert sorted(r.seq for r in got) == one_scan(v, threshold)


def test_bounds_leave_out_nothing():
    """Any vector above the threshold is in a reached cell, for norms of all kinds."""
    rng = np.random.default_rng(8)
    for scale in (0.0, 0.5):
        v = unit(rng.normal(size=(600, 4))) * np.exp(rng.normal(size=(600, 1)) * scale)
        pivots = cells.Pivots({3: v[:2], 7: v[:25]})
        for threshold in (-0.2, 0.3, 0.9):
            home, row, cell = pivots.reached(7, v, threshold, np.linalg.norm(v, axis=1).max())
            met = set(zip(row.tolist(), cell.tolist())) | set(enumerate(home.tolist()))
            i, j = np.nonzero(v @ v.T > threshold)
            assert all((a, home[b]) in met for a, b in zip(i.tolist(), j.tolist())) and home.min() >= 2
        assert scale or len(met) < 600 * 25


def test_two_hundred_thousand_rows_in_one_group(spark):
    """Equal to one scan, and a small part of all pairs is compared."""
    rng = np.random.default_rng(3)
    n = 200_000
    v = unit(unit(rng.normal(size=(4000, 16)))[rng.integers(0, 4000, n)] + rng.normal(size=(n, 16)) * 0.04)
    count = spark.sparkContext.accumulator(0)
    path = f"{shared_dir(spark)}/rows"
    table(spark, v).repartition(8).write.mode("overwrite").parquet(path)
    got = dedup.greedy_keep(spark.read.parquet(path), "grp", "seq", "v", 0.95, count).select("seq").collect()
    print("comparisons", count.value, "of", n * (n - 1) // 2)
    assert 0 < count.value < n * (n - 1) / 2 / 10
    assert sorted(r.seq for r in got) == one_scan(v, 0.95)


def test_rounds_of_a_small_head_grow(spark, monkeypatch):
    """Unlike rows, of which nearly all stay: the rounds don't grow with the rows over ``group_rows``."""
    v = unit(np.random.default_rng(5).normal(size=(1000, 24)))
    rounds, reaching = [], dedup._reaching
    monkeypatch.setattr(dedup, "_reaching", lambda rows: rounds.append(1) or reaching(rows))
    got = dedup.greedy_keep(table(spark, v), "grp", "seq", "v", 0.75, group_rows=20).collect()
    assert sorted(r.seq for r in got) == one_scan(v, 0.75)
    assert len(rounds) <= 20
