"""Semantic filter: entity spans of a text, their mean score and density, and the decision to keep it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.fixed import DEFAULT_LABELS, ENTITY_SCORE_FLOOR, STOP_WORDS, THRESHOLD_DENSITY, THRESHOLD_SCORE
from quarry.functions.text import tokens

ENTITIES = "array<struct<start:int,end:int,label:string,score:double>>"

#: Gives the spans of each of some texts, as dicts with start, end, label and score.
Tagger = Callable[[list[str]], list[list[dict]]]


@dataclass(frozen=True)
class GazetteerTagger:
    """A deterministic stand-in for a neural tagger: words between white space that are listed terms.

    ``terms`` maps a lower-case word to its label and score.
    """

    terms: dict

    def __call__(self, texts: list[str]) -> list[list[dict]]:
        import re

        out = []
        for text in texts:
            found = ((m.start(), m.end(), self.terms.get(m[0].lower())) for m in re.finditer(r"\S+", text))
            out.append([{"start": a, "end": b, "label": x[0], "score": x[1]} for a, b, x in found if x])
        return out


def tag_entities(df: DataFrame, make_tagger: Callable[[], Tagger], labels=DEFAULT_LABELS, floor: float = ENTITY_SCORE_FLOOR, text: str = "text", into: str = "entities") -> DataFrame:
    """``df`` with the spans of ``labels`` scored at least ``floor``; the tagger is made once a worker task."""
    own = [f for f in df.schema.fields if f.name != into]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + f", `{into}` {ENTITIES}"

    def tag(batches: Iterator):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64())]))
        tagger = make_tagger()
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            spans = [[e for e in x if e["label"] in labels and e["score"] >= floor] for x in tagger(texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), pa.array(spans, kind)], [*(f.name for f in own), into])

    return df.mapInArrow(tag, schema)


def content_tokens(text: Column, stop_words=STOP_WORDS) -> Column:
    """The words that aren't stop words; punctuation on a word counts as part of it."""
    return F.filter(tokens(text), lambda w: ~F.lower(w).isin(list(stop_words))) if stop_words else tokens(text)


def count_words(text: Column, ignore_stop_words: bool = False, stop_words=STOP_WORDS) -> Column:
    return F.size(content_tokens(text, stop_words) if ignore_stop_words else tokens(text))


def mean_score(entities: Column) -> Column:
    """The entities' mean score; zero if there are none."""
    total = F.aggregate(entities, F.lit(0.0), lambda acc, e: acc + e["score"])
    return F.when(F.size(entities) > 0, total / F.size(entities)).otherwise(0.0)


def density(entities: Column, text: Column, ignore_stop_words: bool = False, stop_words=STOP_WORDS) -> Column:
    """Words in entities by words in the text. Words in two entities count twice; zero without words."""
    # The text is taken apart into characters once; a span is cut from them by place, so the cost is that of the text and its spans.
    inside = F.element_at(F.transform(F.array(F.split(text, "", -1)), lambda chars: F.aggregate(
        entities, F.lit(0),
        lambda acc, e: acc + count_words(F.array_join(F.slice(chars, e["start"] + 1, e["end"] - e["start"]), ""), ignore_stop_words, stop_words),
    )), 1)
    words = count_words(text, ignore_stop_words, stop_words)
    return F.when((words > 0) & (F.size(entities) > 0), inside / words).otherwise(0.0)


@dataclass(frozen=True)
class FilterConfig:
    labels: tuple = DEFAULT_LABELS
    threshold_score: float = THRESHOLD_SCORE
    threshold_density: float = THRESHOLD_DENSITY
    ignore_stop_words: bool = False

    @classmethod
    def of(cls, config: dict, ignore_stop_words: bool = False) -> FilterConfig:
        """From a configuration file's table; what it doesn't set keeps its default."""
        given = {k: config[k] for k in ("threshold_score", "threshold_density") if k in config}
        return cls(labels=tuple(config.get("labels", DEFAULT_LABELS)), ignore_stop_words=ignore_stop_words, **given)


def scored(df: DataFrame, config: FilterConfig = FilterConfig(), text: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """``df`` (with ``entities``) with score, density and keep; both thresholds are inclusive."""
    df = df.withColumns({"score": mean_score(F.col("entities")), "density": density(F.col("entities"), F.col(text), config.ignore_stop_words, stop_words)})
    return df.withColumn("keep", (F.col("score") >= config.threshold_score) & (F.col("density") >= config.threshold_density))


def semantic_filter(df: DataFrame, make_tagger: Callable[[], Tagger], config: FilterConfig = FilterConfig(), enabled: bool = True, text: str = "text") -> DataFrame:
    """The rows rich enough in entities, with the columns they came with; all of them if not ``enabled``."""
    if not enabled:
        return df
    tagged = tag_entities(df, make_tagger, config.labels, text=text, into="_entities")
    score, dense = mean_score(F.col("_entities")), density(F.col("_entities"), F.col(f"`{text}`"), config.ignore_stop_words)
    return tagged.filter((score >= config.threshold_score) & (dense >= config.threshold_density)).select(*(F.col(f"`{c}`") for c in df.columns))
