"""Model output to validated concept rows.

The JSON rules are those of a strict parser with one retry, which no built-in
has, so one Arrow-batched function turns the raw text into a typed record; all
that follows (gates, normal forms, splitting, synonyms) is native.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.fixed import CATEGORIES, CODE_FENCE, MAX_EVIDENCE_WORDS, PREDICATES, STOP_WORDS
from quarry.functions.junk import is_junk, normalize
from quarry.functions.text import strip, truncate_words

RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("item_id", "concept", "category", "evidence", "predicate", "target")] + [T.StructField("synonyms", T.ArrayType(T.StringType()))]
)

_FENCE = re.compile(CODE_FENCE, re.IGNORECASE)


def loads_object(raw: str | None) -> dict | None:
    """The JSON object in a model's answer: all of it less a code fence, or else from the first { to the last }."""
    if raw is None:
        return None
    text = _FENCE.sub("", raw.strip())
    for candidate in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        return value if isinstance(value, dict) else None
    return None


def record(raw: str | None, item_id: str | None = None) -> dict | None:
    """The typed fields of an answer; None if there is no object or a field can't be of its type."""
    data = loads_object(raw)
    if data is None:
        return None
    if item_id is not None:
        data["item_id"] = item_id
    text = lambda x: str(x) if x else ""
    category, evidence, relation = data.get("category") or "", data.get("evidence") or "", data.get("relation")
    if not isinstance(category, str) or not isinstance(evidence, str):
        return None
    relation = relation if isinstance(relation, dict) else {}
    predicate = relation.get("predicate") or ""
    synonyms = data.get("synonyms")
    return {
        "item_id": text(data.get("item_id")), "concept": text(data.get("concept_proposed")), "category": category, "evidence": evidence,
        "predicate": predicate if isinstance(predicate, str) else None, "target": text(relation.get("target_concept")),
        "synonyms": [s for s in synonyms if isinstance(s, str)] if isinstance(synonyms, list) else [],
    }


@F.pandas_udf(RECORD)
def parsed(raw: pd.Series, item_id: pd.Series) -> pd.DataFrame:
    names = RECORD.names
    rows = [record(None if pd.isna(r) else r, None if pd.isna(i) else i) or dict.fromkeys(names) for r, i in zip(raw, item_id)]
    return pd.DataFrame(rows, columns=names)


@F.pandas_udf(T.BooleanType())
def is_object(raw: pd.Series) -> pd.Series:
    """Whether a model's answer holds a JSON object."""
    return raw.map(lambda x: not pd.isna(x) and loads_object(x) is not None).astype(bool)


def _term(x: Column) -> Column:
    return normalize(F.replace(x, F.lit("_"), F.lit(" ")))


def evidence_words(text: Column) -> Column:
    return truncate_words(text, MAX_EVIDENCE_WORDS)


def answers_with_terms(df: DataFrame, raw: str = "raw", item_id: str | None = None, stop_words=STOP_WORDS, blacklist=()) -> DataFrame:
    """One row an answer: the other columns of ``df``, the fields that its concepts share, and ``terms``, the valid concepts as (place, concept).

    An answer without item id, known category and evidence has no terms. With
    ``item_id`` that column replaces the answer's own id. A null answer has none.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in (raw, "item_id", "_r")]
    junk = lambda x: is_junk(x, stop_words, blacklist)
    given = F.col(item_id).cast("string") if item_id else F.lit(None).cast("string")
    rows = df.select(*others, parsed(F.col(raw), given).alias("_r")).select(*others, "_r.*")
    rows = rows.select(
        *others, strip("item_id").alias("item_id"), normalize(F.col("category")).alias("category"), evidence_words(F.col("evidence")).alias("evidence"),
        normalize(F.col("predicate")).alias("_p"), _term(F.col("target")).alias("_t"), F.col("concept").alias("_whole"),
        F.filter(F.transform("synonyms", _term), lambda s: (s != "") & (s != _term(F.col("concept"))) & ~junk(s)).alias("_synonyms"),
    )
    good = (F.col("item_id") != "") & F.col("category").isin(list(CATEGORIES)) & (F.col("evidence") != "")
    related = F.col("_p").isin(list(PREDICATES)) & ~junk(F.col("_t"))
    placed = F.transform(F.split("_whole", ",", -1), lambda x, i: F.struct(i.alias("place"), _term(x).alias("concept")))
    terms = F.filter(placed, lambda x: (x["concept"] != "") & ~junk(x["concept"]))
    none = F.array().cast("array<struct<place:int,concept:string>>")
    return rows.select(
        *others, "item_id", "category", "evidence", F.when(related, F.col("_p")).alias("_p"), F.when(related, F.col("_t")).alias("_t"),
        F.array_distinct("_synonyms").alias("synonyms"), F.coalesce(F.when(good, terms), none).alias("terms"),
    )


def concept_rows(answers: DataFrame) -> DataFrame:
    """One row a concept of :func:`answers_with_terms`: the other columns, ``place`` (its order in the answer) and the concept's fields."""
    own = ("item_id", "category", "evidence", "_p", "_t", "synonyms", "terms")
    others = [F.col(f"`{c}`") for c in answers.columns if c not in own]
    rows = answers.select(*others, *own[:-1], F.inline("terms"))
    other = ~F.col("_t").eqNullSafe(F.col("concept"))
    return rows.select(
        *others, "place", "item_id", "concept", "category", F.when(other, F.col("_p")).alias("predicate"), F.when(other, F.col("_t")).alias("target"), "evidence", "synonyms"
    )


def parse_concepts(df: DataFrame, raw: str = "raw", item_id: str | None = None, stop_words=STOP_WORDS, blacklist=()) -> DataFrame:
    """One row a concept: the other columns of ``df`` and ``place`` (its order in the answer), then the concept's fields.

    An answer without item id, known category and evidence gives no row. With
    ``item_id`` that column replaces the answer's own id. A null answer gives none.
    """
    return concept_rows(answers_with_terms(df, raw, item_id, stop_words, blacklist))


def counted_concepts(df: DataFrame, raw: str = "raw", item_id: str | None = None, name: str = "answers") -> tuple[DataFrame, Observation]:
    """(concepts, counts): :func:`parse_concepts`, and how many answers there were and how many were rejected for having no valid concept.

    The counts are observed while the concepts are made, without a second pass, and are
    there once an action on the concepts has ended.
    """
    counts = Observation(name)
    rejected = F.size("terms") == 0
    answers = answers_with_terms(df, raw, item_id).observe(counts, F.count("*").alias("n_answers"), F.count_if(rejected).alias("n_rejected"))
    return concept_rows(answers), counts


def counts_table(spark: SparkSession, counts: Observation, step: str) -> DataFrame:
    """(step, n_answers, n_rejected) of an action that has ended, as a table to keep."""
    found = counts.get
    return spark.createDataFrame([(step, found["n_answers"], found["n_rejected"])], "step string, n_answers long, n_rejected long")


def valid_answers(df: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """The rows of ``df`` whose answer gives at least one concept; ``key`` tells the rows apart."""
    good = parse_concepts(df.select(key, raw), raw).select(key).distinct()
    return df.join(good, key, "left_semi")


def concept_struct() -> Column:
    """A concept row as the nested record that is written: its relation is null unless it has a predicate."""
    relation = F.when(F.col("predicate").isNotNull(), F.struct("predicate", F.col("target").alias("target_concept")))
    return F.struct(
        "item_id", F.col("concept").alias("concept_proposed"), "category", relation.alias("relation"), "evidence",
        F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"),
    )


def parse_array(raw: Column, schema: str) -> Column:
    """The JSON array from the first [ to the last ]; an error if there is none."""
    found = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    return F.when(found == "", F.raise_error(F.lit("no JSON array in the model's output"))).otherwise(F.from_json(found, schema))


def string_list(raw: str | None) -> list[str] | None:
    """The distinct non-blank strings of the JSON array in a text, or None."""
    text = re.sub(r"```[a-zA-Z]*", "", (raw or "").strip())
    a, b = text.find("["), text.rfind("]")
    try:
        value = json.loads(text[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None
    if not isinstance(value, list):
        return None
    return list(dict.fromkeys(s.strip() for s in value if isinstance(s, str) and s.strip()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_string_list(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: string_list(None if pd.isna(x) else x))
