import random

import numpy as np
import pytest

from quarry.operators import dedup, ontology, profile
from quarry.plans.queries import projection
from quarry.sources import readers, sinks

ROWS = "k long, vectors array<array<double>>, mask array<int>, embedding string"


def slow(vectors, mask, pooling):
    own = [v for v, m in zip(vectors or [], mask or []) if m]
    if not own:
        return None
    v = np.array(own[0] if pooling == "first" else np.mean(own, axis=0))
    return v / max(np.linalg.norm(v), 1e-12)


@pytest.mark.parametrize("pooling", ["mean", "first"])
def test_pooling_equals_rows_one_by_one(spark, pooling):
    rng = random.Random(3)
    rows = [(i, [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(n)], [rng.randint(0, 1) for _ in range(n)], "clash") for i, n in enumerate([4, 0, 1, 7, 2, 0, 30, 1, 1])]
    rows += [(100, None, None, "x"), (101, [[0.0, 0.0, 0.0]], [1], "x"), (102, [[1.0, 0.0, 0.0]], [0], "x")]
    df = spark.createDataFrame(rows, ROWS).coalesce(1)
    out = dedup.pooled(df, pooling=pooling)
    assert out.columns == ["k", "embedding"]
    got = {r.k: r.embedding for r in out.collect()}
    for k, v, m, _ in rows:
        expected = slow(v, m, pooling)
        assert (got[k] is None) == (expected is None) and (expected is None or np.allclose(got[k], expected))
    assert dedup.pooled(df.limit(0), pooling=pooling).count() == 0
    with pytest.raises(ValueError):
        dedup.pooled(df, pooling="last")


def test_masks_of_another_length_are_an_error(spark):
    df = spark.createDataFrame([(1, [[1.0]], [1, 1], "x")], ROWS)
    with pytest.raises(Exception, match="different numbers of tokens"):
        dedup.pooled(df).collect()


def test_tokens_of_terms(spark):
    df = spark.createDataFrame([(1, "low_mood today"), (2, None), (3, "mood")], "k long, term string")
    got = {r.k: r for r in dedup.encode_tokens(df, dedup.WordEncoder, "term").collect()}
    assert [len(got[k].vectors) for k in (1, 2, 3)] == [3, 0, 1] and got[1].mask == [1, 1, 1] and got[1].vectors[1] == got[3].vectors[0]
    first = {r.k: r.embedding for r in dedup.pooled(dedup.encode_tokens(df, dedup.WordEncoder, "term"), pooling="first").collect()}
    assert np.allclose(first[1], dedup.HashedEmbedder()(["low"])[0]) and first[2] is None


def test_related_terms(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None), ("d", ""), (None, "e"), ("a", "b")], "concept string, target string")
    assert sorted(r.term for r in ontology.related_terms(rows).collect()) == ["a", "b", "e"]


def test_missing_inputs_are_reported(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    paths = [f"{tmp_path}/a.txt", f"file://{tmp_path}/a.txt", f"{tmp_path}/lost.txt"]
    texts, report = readers.read_present(spark, paths)
    assert [r.text for r in texts.collect()] == ["one", "one"] and sorted(map(tuple, report.collect())) == sorted(zip(paths, [True, True, False]))
    texts, report = readers.read_present(spark, paths[2:])
    assert texts.count() == 0 and [r.found for r in report.collect()] == [False]


def test_projection_equals_principal_components(spark, sf_dir):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    matrix = np.stack([rows[k] for k in sorted(rows)])
    _, _, parts = np.linalg.svd(matrix - matrix.mean(axis=0), full_matrices=False)
    parts = [p * (1 if max(p, key=abs) > 0 else -1) for p in parts[:2]]
    for r in projection(spark, sf_dir).collect():
        assert np.allclose([r.x, r.y], [rows[r.vec_id] @ p for p in parts], atol=1e-6)


@pytest.mark.parametrize("bounds", [(4096, 40), (30, 10), (0, 0)])
def test_profiles_don_t_depend_on_where_values_are_counted(spark, monkeypatch, bounds):
    monkeypatch.setattr(profile, "SET_MOST", bounds[0])
    monkeypatch.setattr(profile, "LIST_MOST", bounds[1])
    rows = [(i, i % 20, i % 21, None, float(i % 3), ["x", "y"][i % 2], [i % 5], -0.0 if i % 2 else 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b int, c int, d string, e double, f string, g array<int>, h double")
    got = {r.name: r for r in profile.profile(df, ["a"]).collect()}
    assert [got[c].n_distinct for c in "abcdefgh"] == [400, 20, 21, 0, 3, 2, 5, 1]
    assert got["b"]["values"] == [str(i) for i in range(20)] and got["c"]["values"] is None and got["f"]["values"] == ["x", "y"] and got["d"].type == "empty"


def test_prompt_files(spark, tmp_path):
    (tmp_path / "system_prompt.txt").write_text(" Answer é.\n\n")
    (tmp_path / "user_template.txt").write_text("Read:\n{txt}\n")
    assert readers.read_prompts(spark, str(tmp_path)) == ("Answer é.", "Read:\n{txt}")
    (tmp_path / "user_template.txt").write_text("Read.")
    with pytest.raises(ValueError):
        readers.read_prompts(spark, str(tmp_path))


def test_rows_as_files(spark, tmp_path):
    df = spark.createDataFrame([(f"f{i}.txt", None if i == 3 else f"text é {i}\n") for i in range(20)], "name string, text string").repartition(4)
    for folder in (f"{tmp_path}/a", f"file://{tmp_path}/b"):
        assert [sinks.write_texts(df, folder) for _ in range(2)] == [20, 20]
    for x in "ab":
        files = sorted((tmp_path / x).iterdir())
        assert len(files) == 20 and {f.name: f.read_text() for f in files} == {r.name: r.text or "" for r in df.collect()}
    assert sinks.write_texts(df.limit(0), f"{tmp_path}/c") == 0
