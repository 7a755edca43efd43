import json

import pytest

from quarry.operators import concepts, ontology, profile
from quarry.sources import readers, sinks


def test_texts_and_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo é", encoding="utf-8")
    row = readers.read_texts(spark, str(tmp_path / "a.txt")).first()
    assert row.text == "one\ntwo é" and row.source.endswith("a.txt")
    spark.createDataFrame([(i, f"t{i}") for i in range(9)], "k int, full_note string").write.parquet(str(tmp_path / "c"))
    assert [r.text for r in readers.read_corpus(spark, str(tmp_path / "c"), "full_note", order_by="k", most=3).collect()] == ["t0", "t1", "t2"]
    assert readers.existing([str(tmp_path / "a.txt"), "/no/such"]) == ([str(tmp_path / "a.txt")], ["/no/such"])
    with pytest.raises(ValueError):
        readers.read_texts(spark, [])


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
@pytest.mark.parametrize("encoding", ["utf-8-sig", "latin-1"])
def test_csv(spark, tmp_path, sep, encoding):
    path = tmp_path / "x.csv"
    path.write_bytes("".join(sep.join(r) + "\n" for r in [("id", "name", "v"), ("1", "é b", "2.5"), ("2", "c", "3")]).encode(encoding))
    df = readers.read_csv(spark, str(path))
    assert df.columns == ["id", "name", "v"] and [tuple(r) for r in df.collect()] == [(1, "é b", 2.5), (2, "c", 3.0)]


def test_csv_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
    (tmp_path / "y.csv").write_text("abc\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "y.csv"))


def test_questionnaires_and_jobs(spark, tmp_path):
    data = {"Q1": {"response_type": "r", "scale": "s", "items": [{"item_id": "a", "question": "x?"}, {"item_id": "b", "question": "y?"}]}, "Q2": {"response_type": "t", "scale": "u", "items": []}}
    (tmp_path / "q.json").write_text(json.dumps(data))
    rows = readers.read_questionnaires(spark, str(tmp_path / "q.json")).orderBy("place").collect()
    assert [(r.questionnaire, r.item_id, r.question, r.scale) for r in rows] == [("Q1", "a", "x?", "s"), ("Q1", "b", "y?", "s")]
    values = [({"d": [{"item_id": "i", "concept_proposed": " c "}, {"concept_proposed": ""}, {"item_id": "j", "concept_proposed": None}], "e": "text"},), ([{"concept_proposed": "k"}],)]
    jobs = readers.verification_jobs(spark.createDataFrame([(json.dumps(v),) for (v,) in values], "value string"))
    assert sorted(map(tuple, jobs.collect())) == [("d", "i", "c"), ("default", "", "k")]


def test_small_files(tmp_path, monkeypatch):
    (tmp_path / "c.toml").write_text('threshold_score = 0.05\nlabels = ["a"]')
    assert readers.read_toml(str(tmp_path / "c.toml"))["labels"] == ["a"]
    for data in (["A ", "b"], {"blacklist": ["b", "a"]}):
        (tmp_path / "b.json").write_text(json.dumps(data))
        assert readers.read_blacklist(str(tmp_path / "b.json")) == ["a", "b"]
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.read_blacklist(str(tmp_path / "b.json"))
    assert readers.stop_words(str(tmp_path / "none")) == [] and "the" in readers.stop_words()
    monkeypatch.delenv("TERMINOLOGY_API_KEY", raising=False)
    with pytest.raises(SystemExit):
        readers.api_key()


def test_sinks(spark, tmp_path):
    raw = json.dumps({"item_id": "i", "concept_proposed": "low mood", "category": "finding", "evidence": "é, \"x\"", "relation": {"predicate": "is_a", "target_concept": "mood"}, "synonyms": ["sad", "gloomy"]})
    rows = concepts.parse_concepts(spark.createDataFrame([("s", raw)], "source string, raw string"))
    sinks.write_csv(sinks.concept_csv_rows(rows), str(tmp_path / "csv"))
    lines = [x for p in sorted((tmp_path / "csv").glob("part*")) for x in p.read_text(encoding="utf-8").splitlines()]
    assert list(dict.fromkeys(lines)) == ['﻿item_id,concept_proposed,category,relation,evidence,synonyms', 'i,low mood,finding,is_a -> mood,"é, ""x""",sad; gloomy']
    sinks.write_by_source(rows.withColumnRenamed("place", "seq"), str(tmp_path / "json"))
    record = json.loads(next((tmp_path / "json").glob("part*")).read_text(encoding="utf-8"))
    assert record["concepts"][0]["relation"] == {"predicate": "is_a", "target_concept": "mood"}
    table = spark.createDataFrame([(1, "a"), (2, "b")], "n int, x string")
    path = sinks.write_profile(profile.profile(table, ["n"]), "/data/my base.csv", profile.dataset_id(table.columns), str(tmp_path))
    saved = json.loads(open(path, encoding="utf-8").read())
    assert path.endswith(f"my_base_{saved['dataset_id']}/variables.json") and [v["name"] for v in saved["variables"]] == ["n", "x"]
    schema = "seq int, variable string, normalized_concept string, semantic_category string, relation string, evidence string, preferred_label string, identifier_uri string, match string, validation_status string"
    found = ontology.triples(spark.createDataFrame([(1, "v", "c", "k", None, "e", "", "", "", "Correct")], schema))
    sinks.write_turtle(found, str(tmp_path / "ttl"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "ttl").glob("part*")))
    assert written.startswith("@prefix proj:") and "proj:c rdfs:subClassOf proj:k ;" in written
