import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import align, concepts, dedup, generation, ontology, profile, semfilter
from quarry.plans import pipelines
from quarry.sources import readers

OK = {"item_id": "i1", "concept_proposed": "Low_mood, the, Fatigue", "category": "Finding ", "evidence": "some words", "relation": {"predicate": "is_a", "target_concept": "fatigue"}, "synonyms": ["fatigue", 3, "Low_mood", "xy-12", "low mood"]}


def parse(spark, *raw):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "n int, raw string")
    return [r.asDict() for r in concepts.parse_concepts(df).orderBy("n", "place").collect()]


def test_concepts(spark):
    rows = parse(spark, json.dumps(OK))
    assert [(r["concept"], r["predicate"], r["target"], r["synonyms"]) for r in rows] == [("low mood", "is_a", "fatigue", ["fatigue", "low mood"]), ("fatigue", None, None, ["fatigue", "low mood"])]
    assert rows[0]["category"] == "finding" and rows[0]["item_id"] == "i1"


@pytest.mark.parametrize("raw, n", [
    ("```json\n{}\n```", 2), ("Sure: {} ok", 2), ("[{}]", 0), ("Sure: [{}]", 2), ("{} {}", 0), ("{", 0), (None, 0), ("", 0), ("'x'", 0),
])
def test_answers(spark, raw, n):
    assert len(parse(spark, raw and raw.replace("{}", json.dumps(OK)))) == n


@pytest.mark.parametrize("change, n", [
    ({"item_id": 0}, 0), ({"item_id": 5}, 2), ({"category": "observable entity"}, 0), ({"category": "observable_entity"}, 2), ({"evidence": " "}, 0), ({"category": 3}, 0), ({"evidence": ["x"]}, 0),
    ({"relation": "x"}, 2), ({"relation": None}, 2), ({"synonyms": "x"}, 2), ({"concept_proposed": None}, 0), ({"concept_proposed": "12, the"}, 0), ({"concept_proposed": ["a1", "b1"]}, 2),
])
def test_gates(spark, change, n):
    assert len(parse(spark, json.dumps(OK | change))) == n


def test_relation_rules(spark):
    for relation, expected in (({"predicate": "is a", "target_concept": "x y"}, None), ({"predicate": " IS_A", "target_concept": "x_y"}, "x y"), ({"predicate": "is_a", "target_concept": "12"}, None)):
        assert parse(spark, json.dumps(OK | {"relation": relation}))[0]["target"] == expected


def test_lists(spark):
    assert concepts.string_list('```x\n["a", " a ", 3, "b"] tail') == ["a", "b"] and concepts.string_list("none") is None
    df = spark.createDataFrame([('text [{"variable": "v"}] end',)], "raw string")
    assert df.select(concepts.parse_array(F.col("raw"), "array<struct<variable:string>>").alias("x")).first().x[0].variable == "v"
    with pytest.raises(Exception, match="no JSON array"):
        spark.createDataFrame([("none",)], "raw string").select(concepts.parse_array(F.col("raw"), "array<struct<variable:string>>")).collect()


def test_density_counts_overlaps_twice(spark):
    spans = [{"start": 0, "end": 5, "label": "x", "score": 0.2}, {"start": 2, "end": 7, "label": "x", "score": 0.4}]
    df = spark.createDataFrame([("aa bb cc dd", spans), ("", spans[:1]), ("aa bb", [])], f"text string, entities {semfilter.ENTITIES}")
    rows = semfilter.scored(df.select("text", "entities")).collect()
    assert [(round(r.score, 6), r.density, r.keep) for r in rows] == [(0.3, 1.0, True), (0.2, 0.0, False), (0.0, 0.0, False)]


def test_filter_config_and_bypass(spark):
    config = semfilter.FilterConfig.of({"threshold_score": 0.05, "labels": ["a"]}, True)
    assert (config.threshold_score, config.threshold_density, config.labels, config.ignore_stop_words) == (0.05, 0.05, ("a",), True)
    df = spark.createDataFrame([("fever and rest", 1), ("nothing", 2)], "text string, entities int")
    tagger = lambda: semfilter.GazetteerTagger({"fever": ("symptom", 0.5)})
    assert [r.entities for r in semfilter.semantic_filter(df, tagger).collect()] == [1]
    assert semfilter.semantic_filter(df, tagger, enabled=False).count() == 2


def test_exact_first_and_greedy(spark):
    df = spark.createDataFrame([("g", 1, "a", "x"), ("g", 0, "a", "y"), ("h", 2, "a", "z"), ("g", 3, None, "n"), ("g", 4, None, "m")], "g string, seq int, k string, v string")
    assert sorted(r.v for r in dedup.exact_first(df, ["k"], ["seq"], "g").collect()) == ["n", "y", "z"]
    v = [("g", 0, [1.0, 0.0]), ("g", 1, [0.8, 0.6]), ("g", 2, [0.28, 0.96]), ("h", 3, [1.0, 0.0])]
    vectors = spark.createDataFrame(v, "g string, seq int, e array<double>")
    for keep in (dedup.greedy_keep, dedup.greedy_keep_native):
        assert sorted(r.seq for r in keep(vectors, "g", "seq", "e", 0.7).collect()) == [0, 2, 3]
        assert sorted(r.seq for r in keep(vectors, "g", "seq", "e", 0.8).repartition(3).collect()) == [0, 1, 2, 3]


def test_concept_in_two_categories_is_one(spark):
    df = spark.createDataFrame([("s", 0, "low mood", "finding"), ("s", 1, "low mood", "symptom"), ("t", 0, "low mood", "finding")], "source string, seq int, concept string, category string")
    assert sorted((r.source, r.seq) for r in dedup.dedup_concepts(df, "source", "seq").collect()) == [("s", 0), ("t", 0)]


def terminology(spark):
    rows = [("r1", "a", None, 0, [1.0, 0.0]), ("r2", "b", None, 1, [0.0, 1.0]), ("c1", "c", "r1", 1, [0.8, 0.6]), ("c0", "d", "r1", 0, [0.8, 0.6]), ("x", "e", "c0", 0, [0.6, 0.8]), ("s", "f", "r2", 0, [0.0, 1.0])]
    return spark.createDataFrame(rows, "code string, display string, parent_code string, pos int, embedding array<double>")


def test_descent(spark):
    q = spark.createDataFrame([(1, [0.8, 0.6]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [1.0, 0.0])], "k int, embedding array<double>")
    got = {r.k: (r.code, round(r.score, 6), r.accepted) for r in align.descend(q, terminology(spark), "k", threshold=0.99).collect()}
    assert got == {1: ("c0", 1.0, True), 2: ("r2", 1.0, True), 3: ("r2", 0.8, False), 4: ("r1", 1.0, True)}
    assert {(r.ancestor, r.code, r.depth) for r in align.descendants(terminology(spark)).collect()} >= {("r1", "x", 2), ("r2", "s", 1)}
    assert align.children(terminology(spark), 1).filter("parent_code = 'r1'").first().code == "c0"


def test_verification(spark):
    jobs = spark.createDataFrame([(1, "Low_mood"), (2, "zzz"), (3, "a")], "k int, concept string")
    terms = spark.createDataFrame([(" low  MOOD",), ("",)], "term string")
    vectors = dedup.embed(terminology(spark).drop("embedding"), dedup.HashedEmbedder, "display")
    out = pipelines.verification_track(jobs, terms, vectors, "k", threshold=0.9)
    assert {r.k: (r.found, r.semantic) for r in out.collect()} == {1: (1, "n/a"), 2: (0, "0"), 3: (0, "1")}
    assert tuple(align.summary(out).first()) == (3, 1, 2)


@pytest.mark.parametrize("values, kind, expected", [
    ([1, 2], "int", ("identifier", None, None)), ([1.0, 2.5], "double", ("binary numeric", "1.0|2.5", None)), ([None, None], "int", ("empty", None, None)), ([5], "int", ("identifier", None, None)),
    (["a", "b", "a"], "string", ("binary text", "a|b", None)), ([1.0, 2.0, 2.0, 4.0], "double", ("integer", "1.0|2.0|4.0", None)), ([True, False, True], "boolean", ("binary numeric", "false|true", None)),
    ([f"t{i}" for i in range(30)], "string", ("identifier", None, None)), ([i / 2 for i in range(30)], "double", ("decimal", None, "any value between 0.0 and 14.5")),
    ([i % 20 for i in range(40)], "int", ("integer", "|".join(map(str, range(20))), None)), ([i % 21 for i in range(42)], "int", ("integer", None, "any value between 0 and 20")),
    ([f"{i % 21}" for i in range(42)], "string", ("free text", None, None)), ([float("nan"), 1.0, 1.0], "double", ("integer", "1.0", None)), ([1.0, float("inf"), 2.0, 2.0], "double", ("decimal", "1.0|2.0|Infinity", None)),
])
def test_profile(spark, values, kind, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"n int, `a b` {kind}").repartition(3)
    row = profile.profile(df, ["n"]).filter("pos = 1").first()
    assert (row.type, row["values"] and "|".join(row["values"]), row.range) == expected
    first = next((v for v in values if v is not None and v == v), None)
    assert row.example == (None if first is None else str(first).lower() if kind == "boolean" else str(first))


def test_dataset_id():
    assert profile.dataset_id(["a", "b"]) == profile.dataset_id(["a", "b"]) != profile.dataset_id(["a"])


def test_triples(spark):
    schema = "seq int, variable string, normalized_concept string, semantic_category string, relation string, evidence string, preferred_label string, identifier_uri string, match string, validation_status string"
    rows = [
        (1, "v", "Body-mass index", "Été", None, "e", "l", "u", "Exact", "Correct"), (2, "v 1", 'a"b\\c\nd', "C", "is a", "e", "", "u", "No Match", "Correct"),
        (3, "v", "x", "y", "r", "e", "l", "u", "Exact", None), (4, "v", "x", "y", "r", "e", "l", "u", "Exact", "Odd"),
    ]
    df = spark.createDataFrame(rows, schema)
    found = ontology.triples(df)
    assert found.groupBy("seq").count().orderBy("seq").collect() == [(1, 4), (2, 4)]
    text = ontology.turtle(found)
    assert "proj:Bodymassindex rdfs:subClassOf proj:t ;\n    rdfs:label \"Body-mass index\" ." in text and 'proj:Bodymassindex skos:exactMatch <u> .\n\n<u> rdfs:label "l" .' in text
    assert 'rdfs:label "a\\"b\\\\c\\nd" ;\n    rdfs:comment "e" ;\n    proj:isa proj:v1 .' in text and text.startswith("@prefix proj:")
    assert ontology.turtle(found.filter("false")) is None
    assert {r.status: r.n for r in ontology.status_histogram(df).collect()} == {"Correct": 2, "Incorrect": 0, "Uncertain": 1, "Odd": 1}


def test_generation(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "k int, text string")
    assert df.select(generation.fit_budget(F.col("text"), "s s", "t {txt}", 14)).first()[0] == "one two three"
    assert df.select(generation.fit_budget(F.col("text"), "s s", "t {txt}", 5)).first()[0] == ""
    with pytest.raises(ValueError):
        generation.check_template("none")
    prompt = df.select(generation.chat_prompt(F.col("text"), 'sys "x"', "a {txt} b")).first()[0]
    assert json.loads(prompt)[1] == {"role": "user", "content": "a one two three four five six seven eight nine ten b"}


def test_questionnaire_track(spark):
    items = spark.createDataFrame([("q", "i1", "question one", "t", "s"), ("q", "i2", "question two", "t", "s"), ("q", "i3", "x", "t", "12")], "questionnaire string, item_id string, question string, response_type string, scale string")
    cached = items.filter("item_id = 'i1'").select(generation.signature("s", "m", {}).alias("signature"), "item_id", generation.item_prompt().alias("user_prompt"), F.lit(json.dumps(OK)).alias("raw"))
    out = pipelines.questionnaire_track(items, "s", "m", {}, pipelines.KeywordGenerator, cached)
    found = {(r.item_id, r.concept) for r in out.concepts.collect()}
    assert ("i1", "low mood") in found and ("i1", "fatigue") in found and any(i == "i2" for i, _ in found)
    assert sorted(r.item_id for r in out.cache_additions.collect()) == ["i2", "i3"] and out.missing.count() == 0


def test_tabular_track(spark):
    answer = '[{"variable": "Age", "normalized_concept": "age", "semantic_category": "Demographic", "relation": "describes"}]'
    rows = pipelines.tabular_track(readers.declared_variables(spark), lambda: lambda prompts: [f"Here: {answer}" for _ in prompts]).collect()
    assert [(r.variable, r.validation_status, r.match) for r in rows] == [("Age", "Uncertain", "")] and rows[0].evidence.endswith("description: age in years")


def test_text_track(spark):
    texts = spark.createDataFrame([("a", 1, "fever fever and tiredness"), ("a", 2, "fever fever and tiredness"), ("b", 3, "nothing here")], "source string, doc long, text string")
    out = pipelines.text_track(texts, lambda: semfilter.GazetteerTagger({"fever": ("symptom", 0.5)}), pipelines.KeywordGenerator)
    assert sorted({(r.source, r.concept) for r in out.collect()}) == [("a", "fever"), ("a", "tiredness")] and out.count() == 2
