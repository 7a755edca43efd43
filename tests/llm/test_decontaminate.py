import hashlib
import re

import pytest

from quarry.llm import decontaminate as D
from tests.llm.fixtures import PROSE, documents, empty, whole

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return LETTERS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w, hit, names = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= {str(y) for y in x if y is not None}
        out.append((str(d), len(w), len(hit), ",".join(sorted(names))))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in df.collect())


ITEMS = [(1, "brown fox jumps over the lazy dog, and runs TO the old barn near"), (2, "One-two one two three"), (3, None), (4, "..."), (10, "lazy dog"), (10, "lazy dog"), (None, "far green hills"), (5, "éa")]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_odd_rows(spark):
    docs = documents(spark)
    expected = slow([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert result(D.decontaminate(docs, items(spark, ITEMS))) == expected
    assert result(D.decontaminate(docs, items(spark, []))) == [(d, n, 0, "") for d, n, _, _ in expected]
    assert D.decontaminate(empty(spark), items(spark, ITEMS)).count() == 0


@pytest.mark.parametrize("block", [10**6, 7])
def test_whole_table(spark, sf_dir, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", block if block > 100 else 300)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(d, t) for d, t, _ in whole(spark, sf_dir)]
    expected = slow(rows, [(r.item_id, r.text) for r in bench.collect()])
    assert sum(h > 0 for _, _, h, _ in expected) > 1
    assert result(D.decontaminate(documents(spark, whole(spark, sf_dir)), bench)) == expected


def test_proximity(spark):
    test = items(spark, [(7, "quick brown jumps over lazy dog")])
    row = D.decontaminate(documents(spark, [(1, PROSE, "a"), (2, "dog lazy", "a")]), test).orderBy("doc_id").collect()
    assert (row[0]["items"], row[0].near_items, row[1].near_items) == ([], ["7"], [])


def test_proximity_over_the_whole_slop(spark):
    spread = "w0 x x w1 w2 w3 w4 w5 w6 w7 w8 x x w9"
    docs = documents(spark, [(1, spread, "a"), (2, "y k y y k y y k y y m", "a"), (3, spread.replace("w4", "x"), "a")])
    rows = [(7, " ".join(f"w{i}" for i in range(10))), (8, "k " * 9 + "m")]
    for more in ([], [(9, "zzz")]):
        got = {r.doc_id: (r.near_items, r.n_hit) for r in D.decontaminate(docs, items(spark, rows + more)).collect()}
        assert got == {1: (["7"], 0), 2: (["8"], 0), 3: ([], 0)}


def test_drop(spark):
    docs = documents(spark)
    kept = D.drop_contaminated(docs, items(spark, [(1, "one")]))
    assert kept.columns == docs.columns
    hit = {d for d, _, h, _ in slow([(r.doc_id, r.text) for r in docs.collect()], [(1, "one")]) if h}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if str(r.doc_id) not in hit)


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def slow_near(docs, items, size=10, slop=2):
    """Items of which some window has each word within slop of its place after some start."""
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    by_first = {}
    for window in windows:
        by_first.setdefault(window[0], []).append(window)
    out = []
    for d, text in docs:
        w, names = split(text), set()
        for p, first in enumerate(w):
            for window in by_first.get(first, ()):
                for s in range(p - slop, p + slop + 1):
                    if all(x in w[max(0, s + j - slop) : max(0, s + j + slop + 1)] for j, x in enumerate(window)):
                        names |= {str(y) for y in windows[window] if y is not None}
                        break
        out.append((str(d), ",".join(sorted(names))))
    return sorted(out)


def test_proximity_equals_brute_force(spark):
    """Over the whole table of sf0.01, with items of which words were left out, put in and exchanged."""
    import random

    rng = random.Random(5)
    sf = "/root/testdata/sf0.01"
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, (_, text) in enumerate(bench[:40]):
        w = (text or "").split()
        for _ in range(3):
            k = rng.randrange(max(1, len(w) - 2))
            w[k : k + 2] = w[k : k + 2][::-1]
        w.insert(rng.randrange(len(w) + 1), "zz")
        bench.append((1000 + i, " ".join(w)))
    docs = [(d, t) for d, t, _ in whole(spark, sf)]
    expected = slow_near(docs, bench)
    got = D.decontaminate(spark.read.parquet(f"{sf}/documents.parquet"), items(spark, bench)).collect()
    assert sorted((str(r.doc_id), ",".join(r.near_items)) for r in got) == expected
    assert sum(n.count(",") + 1 for _, n in expected if n) > 20 and any(r.near_items != r["items"] for r in got)


def test_index_holds_every_token_and_serves_any_benchmark(spark, tmp_path):
    docs = documents(spark)
    D.build_index(docs).write.parquet(f"{tmp_path}/i")
    index = spark.read.parquet(f"{tmp_path}/i")
    counted = sum(len(split(r.text)) for r in docs.collect())
    assert index.selectExpr("sum(length(places)) / 4 AS n").first().n == counted
    assert "benchmark" not in str(index.schema) and index.selectExpr("explode(docs)").count() == docs.count()


def test_repeated_rows_give_one_match_each(spark):
    docs = documents(spark, [(1, PROSE, "a")] * 400 + [(None, PROSE, "b")] * 3)
    got = D.decontaminate(docs, items(spark, [(1, "brown fox")])).collect()
    assert len(got) == 403 and {(r.n_hit, tuple(r["items"])) for r in got} == {(2, ("1",))}


def test_drop_carries_clashing_columns_unchanged(spark):
    docs = documents(spark)
    kept = D.drop_contaminated(docs, items(spark, [(1, "one")]))
    assert kept.dtypes == docs.dtypes
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
