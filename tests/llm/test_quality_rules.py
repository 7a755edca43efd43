import re
from collections import Counter

import duckdb

from quarry.llm.quality_rules import keep, quality_rules
from quarry.llm.registry import quality_rules_sql
from tests.llm.fixtures import documents, empty, whole

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def check(df, docs):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in df.collect())
    assert got == sorted((str(d), *slow(t)) for d, t, _ in docs)
    for r in df.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_measures(spark, sf_dir):
    many = " ".join(f"u{i} v{i} w{i} x{i} y{i}" for i in range(60))
    odd = [(r.doc_id, r.text, r.source) for r in documents(spark).collect()] + [(50, f"{many} {many}", "a"), (51, "a " * 9, "a"), (52, "b c d e f g b c d e f", "a")]
    check(quality_rules(documents(spark, odd)), odd)
    check(quality_rules(documents(spark, whole(spark, sf_dir))), whole(spark, sf_dir))
    assert quality_rules(empty(spark)).count() == 0


def test_sql_agrees(spark):
    docs = documents(spark).toArrow()
    con = duckdb.connect()
    con.register("documents", docs)
    expected = con.execute(quality_rules_sql()).fetchall()
    assert sorted(map(str, map(tuple, quality_rules(documents(spark)).collect()))) == sorted(map(str, expected))


def test_keep(spark):
    kept = keep(documents(spark))
    assert kept.columns == documents(spark).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules(documents(spark)).filter("kept").collect()}


def test_keep_carries_clashing_columns_unchanged(spark):
    docs = documents(spark).withColumnsRenamed({"_row_key": "_q_words", "h": "_q_n_words", "rank": "_q_row"}).selectExpr("*", "1.5D AS `a.b`")
    kept = keep(docs)
    assert kept.dtypes == docs.dtypes
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}


def test_no_user_functions(spark):
    plan = quality_rules(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_filters_stay_above_the_measures(spark):
    for df in (keep(documents(spark)), quality_rules(documents(spark)).filter("kept")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert all("split(" not in line for line in plan.splitlines() if line.strip(" +-:").startswith("Filter"))
