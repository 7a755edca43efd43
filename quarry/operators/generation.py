"""Prompts, model calls behind a callable, and the response cache."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.fixed import PROMPT_MARGIN, VARIABLE_LINE, VARIABLES_PROMPT
from quarry.functions.text import tokens
from quarry.operators.concepts import is_object

PLACEHOLDER = "{txt}"

#: Gives the model's answer to each of some prompts; None for none.
Generator = Callable[[list[str]], list[str | None]]


def check_template(template: str) -> str:
    if PLACEHOLDER not in template:
        raise ValueError(f"the user template lacks the placeholder {PLACEHOLDER!r}, so a model would never see the document")
    return template


def chat_prompt(text: Column, system_prompt: str, user_template: str) -> Column:
    """The messages of a chat as a JSON array: system prompt, then the template with the text in it."""
    user = F.replace(F.lit(check_template(user_template)), F.lit(PLACEHOLDER), text)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.array(message("system", F.lit(system_prompt)), message("user", user)))


def fit_budget(text: Column, system_prompt: str, user_template: str, max_length: int = 3000) -> Column:
    """``text`` cut so that the whole prompt has at most ``max_length`` words less a margin.

    Words between white space stand in for a model's tokens; the template is
    never cut, and a text that fits is left as it is.
    """
    overhead = len(system_prompt.split()) + len(check_template(user_template).replace(PLACEHOLDER, "").split())
    budget = max(max_length - overhead - PROMPT_MARGIN, 0)
    words = tokens(text)
    short = F.array_join(F.slice(words, 1, budget), " ") if budget else F.lit("")
    return F.when(F.size(words) <= budget, text).otherwise(short)


def generate(df: DataFrame, make_generator: Callable[[], Generator], prompt: str = "prompt", into: str = "raw") -> DataFrame:
    """``df`` with the stripped answers; the generator is made once a worker task and called a batch at a time."""
    own = [f for f in df.schema.fields if f.name != into]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + f", `{into}` string"

    def run(batches):
        import pyarrow as pa

        generator = make_generator()
        for batch in batches:
            answers = [None if x is None else x.strip() for x in generator(batch.column(prompt).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), pa.array(answers, pa.string())], [*(f.name for f in own), into])

    return df.mapInArrow(run, schema)


def item_prompt(questionnaire: str = "questionnaire", item_id: str = "item_id", question: str = "question", response_type: str = "response_type", scale: str = "scale") -> Column:
    """The five lines that describe a questionnaire item to a model."""
    parts = (("Questionnaire: ", questionnaire, ""), ("Item ID: ", item_id, ""), ('Item text: "', question, '"'), ("Response type: ", response_type, ""), ("Response scale: ", scale, ""))
    return F.concat_ws("\n", *(F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b)) for a, c, b in parts))


def signature(system_prompt: str, model: str, options: dict) -> Column:
    """SHA-256 of what an answer depends on besides the item: prompt, model and options."""
    return F.sha2(F.lit(system_prompt + model + json.dumps(options, sort_keys=True)), 256)


def cache_hits(items: DataFrame, cache: DataFrame) -> DataFrame:
    """``items`` (signature, item_id, user_prompt, ...) with ``raw`` and ``hit``: cached under all three.

    A (signature, item_id) pair is cached with one prompt; if a cache holds several rows of
    one key, the least answer is taken.
    """
    keys = ["signature", "item_id", "user_prompt"]
    own = cache.groupBy(*keys).agg(F.min("raw").alias("raw"), F.lit(True).alias("hit"))
    return items.drop("raw", "hit").join(own, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_misses(items: DataFrame, cache: DataFrame) -> DataFrame:
    return items.join(cache, ["signature", "item_id", "user_prompt"], "left_anti")


def cache_additions(answered: DataFrame) -> DataFrame:
    """The rows to append to the cache: answers that are JSON objects; failures aren't cached."""
    return answered.filter(is_object("raw")).select("signature", "item_id", "user_prompt", "raw")


def variables_prompt(variables: DataFrame, order: str = "seq") -> DataFrame:
    """One row: the prompt for a batch of variables and its id. A batch is as long as one prompt may be."""
    parts = VARIABLE_LINE.replace("{", "|{").replace("}", "}|").split("|{")
    pieces = [F.lit(parts[0])]
    for part in parts[1:]:
        name, rest = part.split("}|", 1)
        pieces += [F.col(name), F.lit(rest)]
    lines = variables.select(F.col(order).alias("_o"), F.concat(*pieces).alias("line"))
    joined = lines.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    text = F.replace(F.replace(F.lit(VARIABLES_PROMPT), F.lit("{n}"), F.col("n").cast("string")), F.lit("{variables}"), F.col("lines"))
    return joined.select(text.alias("prompt")).withColumn("prompt_id", prompt_id(F.col("prompt")))


def prompt_id(prompt: Column) -> Column:
    return F.substring(F.sha1(prompt), 1, 8)
