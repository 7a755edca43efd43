"""The three tracks end to end: texts, questionnaires and tables; models come in as callables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.fixed import SIMILARITY
from quarry.functions.text import clean_text
from quarry.operators import align, concepts, dedup, generation, ontology, semfilter


@dataclass(frozen=True)
class KeywordGenerator:
    """A deterministic stand-in for a generating model: a concept of the longest word of a prompt's last message."""

    item_id: str = "item"

    def __call__(self, prompts: list[str]) -> list[str]:
        import json
        import re

        out = []
        for prompt in prompts:
            try:
                text = json.loads(prompt)[-1]["content"]
            except (ValueError, TypeError, KeyError, IndexError):
                text = prompt or ""
            words = sorted(set(re.findall(r"[^\W\d_]{4,}", text)), key=lambda w: (-len(w), w))[:2]
            out.append(json.dumps({"item_id": self.item_id, "concept_proposed": ", ".join(words), "category": "finding", "relation": None, "evidence": text[:200], "synonyms": []}))
        return out


def text_track(
    texts: DataFrame, make_tagger: Callable, make_generator: Callable, system_prompt: str = "", user_template: str = "{txt}",
    config: semfilter.FilterConfig = semfilter.FilterConfig(), filtering: bool = True, max_length: int = 3000, similarity: float = SIMILARITY,
    make_embedder: Callable = dedup.HashedEmbedder,
) -> DataFrame:
    """Concepts (source, doc, place, ...) of texts (source, doc, text): clean, filter, prompt, generate, parse, deduplicate by source.

    ``doc`` orders a source's texts. The only shuffles are those of the
    deduplication, by source.
    """
    rows = texts.select("source", "doc", clean_text(F.col("text")).alias("text"))
    rows = semfilter.semantic_filter(rows, make_tagger, config, filtering)
    fitted = generation.fit_budget(F.col("text"), system_prompt, user_template, max_length)
    prompts = rows.select("source", "doc", generation.chat_prompt(fitted, system_prompt, user_template).alias("prompt"))
    answers = generation.generate(prompts, make_generator).select("source", "doc", "raw")
    found = concepts.parse_concepts(answers)
    return dedup.dedup_concepts(found, "source", ["doc", "place"], similarity, make_embedder)


@dataclass
class QuestionnaireResult:
    concepts: DataFrame
    cache_additions: DataFrame
    missing: DataFrame


def questionnaire_track(
    items: DataFrame, system_prompt: str, model: str, options: dict, make_generator: Callable, cache: DataFrame, similarity: float = SIMILARITY,
    make_embedder: Callable = dedup.HashedEmbedder,
) -> QuestionnaireResult:
    """Concepts of questionnaire items; an item with a cached answer isn't sent to the model. Each item is a group of its own."""
    keyed = items.withColumns({"user_prompt": generation.item_prompt(), "signature": generation.signature(system_prompt, model, options)})
    marked = generation.cache_hits(keyed, cache)
    asked = generation.generate(marked.filter(~F.col("hit")).drop("raw"), make_generator, "user_prompt")
    valid = asked.withColumn("_ok", concepts.parsed(F.col("raw"), F.col("item_id").cast("string"))["item_id"].isNotNull())
    answered = valid.filter("_ok").drop("_ok")
    answers = marked.filter("hit").select("item_id", "raw").unionByName(answered.select("item_id", "raw"))
    answers = answers.select(F.col("item_id").alias("_item"), "raw")
    found = concepts.parse_concepts(answers, item_id="_item").withColumn("seq", F.col("place"))
    kept = dedup.dedup_concepts(found, "_item", "seq", similarity, make_embedder).drop("_item", "place")
    return QuestionnaireResult(kept, generation.cache_additions(answered), items.join(kept.select("item_id").distinct(), "item_id", "left_anti"))


def verification_track(jobs: DataFrame, terms: DataFrame, terminology: DataFrame, key: str, make_embedder: Callable = dedup.HashedEmbedder, threshold: float = align.DESCENT_THRESHOLD) -> DataFrame:
    """``jobs`` (key, concept, ...) with ``found`` and ``semantic``: lexical lookup, then descent for what wasn't found."""
    found = align.lexical_match(jobs, terms)
    vectors = dedup.embed(found.filter("found = 0").withColumn("_q", align.query_text(F.col("concept"))), make_embedder, "_q").drop("_q")
    accepted = align.semantic_matches(vectors, terminology, key, threshold=threshold)
    return align.tri_state(found, accepted, key)


def tabular_track(variables: DataFrame, make_generator: Callable) -> DataFrame:
    """Alignment rows for a batch of variables: one prompt, one answer, one row a variable, with evidence and manual fields."""
    prompt = generation.variables_prompt(variables)
    schema = "array<struct<variable:string,normalized_concept:string,semantic_category:string,relation:string>>"
    answer = generation.generate(prompt, make_generator).select(F.explode(concepts.parse_array(F.col("raw"), schema)).alias("x")).select("x.*")
    return ontology.enrich(answer, variables)
