import corpus_pipeline
from quarry.llm import quality_rules
from quarry.llm.mixing import mix
from tests.llm import test_decontaminate, test_near_copies, test_tokens
from tests.llm.fixtures import documents, empty


def test_stages(spark, sf_dir, tmp_path):
    assert [k for k, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        kept[i] = (before, docs)
        if i < 4:
            assert docs.columns == columns
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    a, b = kept[0]
    good = {r.doc_id for r in quality_rules.quality_rules(a).filter("kept").collect()}
    assert rows(b) == [(d, t) for d, t in rows(a) if d in good]

    a, b = kept[1]
    groups, pairs = test_near_copies.slow_groups([t for _, t in rows(a)])
    first = {min(g) for g in test_near_copies.partition([d for d, _ in rows(a)], groups)}
    assert rows(b) == [(d, t) for d, t in rows(a) if d in first] and len(pairs) > 0
    left = test_near_copies.slow_groups([t for _, t in rows(b)])[1]
    assert not left  # no two texts of five-word similarity 0.8 or more stay

    a, b = kept[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in test_decontaminate.slow(rows(a), items) if n}
    assert rows(b) == [(d, t) for d, t in rows(a) if str(d) not in hit]

    a, b = kept[3]
    times = {r.doc_id: r.times for r in mix(a).collect()}
    assert rows(b) == sorted((d, t) for d, t in rows(a) for _ in range(times[d]))

    expected = test_tokens.slow([(d, t, None) for d, t in rows(b)])
    assert sorted(map(tuple, kept[4][1].collect()), key=lambda r: r[1]) == expected


def test_run_applies_the_stages_in_order(spark, sf_dir, monkeypatch):
    stages = [("a", lambda s, docs, d: docs.filter("doc_id % 2 = 0")), ("b", lambda s, docs, d: docs.filter("doc_id % 3 = 0").select("doc_id"))]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted((r.doc_id,) for r in docs.filter("doc_id % 6 = 0").collect())


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, ties, repeated rows and clashing names; every carried column keeps its values and type."""
    docs = documents(spark).withColumnRenamed("_row_key", "_q_words").selectExpr("*", "cast(doc_id AS decimal(20,2)) AS `a.b`")
    rows = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes, name
        assert {tuple(r) for r in out.collect()} <= rows, name
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).collect()
    assert kept and all(r.text and r.text.strip() for r in kept)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in tokens) == sorted(str(r.doc_id) for r in docs.collect())


def test_stages_on_an_empty_table(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), sf_dir).count() == 0
