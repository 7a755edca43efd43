import pytest

from quarry.llm import line_dedup as L
from tests.llm.fixtures import documents, empty, whole


def slow(docs, least):
    sites = {}
    for _, t, s in docs:
        for x in (t or "").split("\n"):
            sites.setdefault(x, set()).add(s)
    out = []
    for d, t, _ in docs:
        filled = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        gone = [x for x in filled if len(sites[x]) >= least]
        text = None if t is None else "\n".join(x for x in t.split("\n") if x not in gone)
        out.append((str(d), len(filled), len(gone), str(text)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_removed, str(r.text)) for r in df.collect())


@pytest.mark.parametrize("least", [2, 10])
def test_whole_table(spark, sf_dir, least):
    docs = whole(spark, sf_dir)
    assert result(L.line_dedup(documents(spark, docs), least)) == slow(docs, least)


def test_odd_rows(spark):
    lines = [(200 + i, f"common\nown {i}\n\ncommon\n{'few' if i < 4 else 'x'}", f"s{i}" if i else None) for i in range(12)]
    docs = [(r.doc_id, r.text, r.source) for r in documents(spark).collect()] + lines
    for least in (1, 3, 4, 5, 12, 13):
        assert result(L.line_dedup(documents(spark, docs), least)) == slow(docs, least)
    assert L.line_dedup(empty(spark)).count() == 0


def test_no_user_functions(spark):
    assert "Python" not in L.line_dedup(documents(spark))._jdf.queryExecution().executedPlan().toString()


def test_hot_lines_beyond_the_broadcast_bound(spark, monkeypatch):
    """More boilerplate lines than may be broadcast, one of them in a third of all rows; lines that differ get different hashes."""
    from quarry.llm import common

    monkeypatch.setattr(L, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    docs = [(i, "\n".join(["the very frequent line"] * (i % 3 == 0) + [f"shared {i % 40}", f"own {i}"]), f"s{i % 17}") for i in range(1500)]
    assert result(L.line_dedup(documents(spark, docs), 10)) == slow(docs, 10)


def test_hash_halves_are_independent(spark):
    df = spark.createDataFrame([(f"line {i}",) for i in range(50)], "x string")
    a = df.select(L.row_key("x").alias("k")).select("k.a", "k.b").collect()
    import xxhash

    wrong = [xxhash.xxh64_intdigest(b"line", r.a & (2**64 - 1)) for r in a]
    assert all(r.b & (2**64 - 1) != w for r, w in zip(a, wrong)) and len({r.b for r in a}) == 50


def test_time_is_linear_in_lines(spark):
    """A text of which half of very many lines go; looking each place up in a list would take minutes."""
    n = 60_000
    docs = [(1, "\n".join(f"line {i}" for i in range(n)), "a"), (2, "\n".join(f"line {i}" for i in range(0, n, 2)), "b")]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in L.line_dedup(documents(spark, docs), 2).collect()}
    assert got == {1: (n, n // 2), 2: (n // 2, n // 2)}
