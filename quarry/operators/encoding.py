"""Prompts within a token budget, as left-padded ids and masks in batches of like lengths.

A tokenizer comes in as a callable that makes one on a worker; it has ``encode_batch``,
whose answers have ``ids`` and ``offsets`` in characters. All steps are Arrow-batched and
narrow: no row meets another but those of its own batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.fixed import PROMPT_MARGIN
from quarry.operators.generation import PLACEHOLDER, check_template

#: Texts that a tokenizer gets at once.
TEXTS = 256

#: Prompts of a model batch, and batches that are held while rows of like length are brought together.
BATCH_SIZE, HELD_BATCHES = 4, 64

#: Makes a tokenizer on a worker.
MakeTokenizer = Callable[[], object]

#: Gives a model's answers to a matrix of left-padded ids and their mask.
BatchModel = Callable[[object, object], list]


def plain_chat(system: str, user: str) -> str:
    """A chat of both messages as one string that ends where the answer begins; models bring their own form of it."""
    return f"<|system|>\n{system}\n<|user|>\n{user}\n<|assistant|>\n"


def file_tokenizer(path: str) -> MakeTokenizer:
    """A maker of the tokenizer of a file, without truncation and padding of its own."""

    def make():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    return make


def encoded(tokenizer, texts: list[str], places: bool = True) -> Iterator:
    """The tokenizer's answers to ``texts``; without ``places`` by its method that makes ids only, if it has one."""
    encode = tokenizer.encode_batch if places else getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    for at in range(0, len(texts), TEXTS):
        yield from encode(texts[at : at + TEXTS], add_special_tokens=False)


def cut_at(ids, offsets, budget: int) -> int | None:
    """The number of characters that the first ``budget`` tokens hold whole; None if there are no more tokens than that.

    Tokens may be parts of a character. One that isn't whole is left out.
    """
    if len(ids) <= budget:
        return None
    if not budget:
        return 0
    return min(offsets[budget - 1][1], offsets[budget][0])


class Spans:
    """The places of single tokens in characters; all places of a long text cost as much as a tenth of its encoding."""

    def __init__(self, answer):
        one = getattr(answer, "token_to_chars", None)
        self.of = one or answer.offsets.__getitem__

    def __getitem__(self, i: int) -> tuple[int, int]:
        return self.of(i)


def token_budget(tokenizer, system: str, template: str, max_length: int, chat: Callable = plain_chat) -> int:
    """Tokens that a text may have so that the whole prompt has ``max_length`` less a margin."""
    empty = chat(system, check_template(template).replace(PLACEHOLDER, ""))
    return max(max_length - len(next(encoded(tokenizer, [empty])).ids) - PROMPT_MARGIN, 0)


def fit_tokens(tokenizer, texts: list[str], budget: int) -> tuple[list[str], list[int]]:
    """``texts`` cut to ``budget`` tokens, and how many tokens they had."""
    fitted, sizes = [], []
    for t, x in zip(texts, encoded(tokenizer, texts)):
        ids = x.ids
        sizes.append(len(ids))
        fitted.append(t if len(ids) <= budget else t[: cut_at(ids, Spans(x), budget)])
    return fitted, sizes


def encode_prompts(
    df: DataFrame, make_tokenizer: MakeTokenizer, system: str, template: str, max_length: int = 3000, text: str = "text", chat: Callable = plain_chat
) -> DataFrame:
    """``df`` with ``n_tokens`` of its text, ``fitted`` (the text cut to the budget) and ``input_ids`` of the whole prompt.

    Only the text is cut, at the end of its last whole character within the budget;
    system prompt and template stay whole, also where they alone fill ``max_length``. A null text is empty.
    """
    check_template(template)
    new = {"n_tokens": "long", "fitted": "string", "input_ids": "array<int>"}
    own = [f for f in df.schema.fields if f.name not in new]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), *(f"{k} {v}" for k, v in new.items())])

    def run(batches):
        import pyarrow as pa

        tokenizer = make_tokenizer()
        budget = token_budget(tokenizer, system, template, max_length, chat)
        for whole in batches:
            for at in range(0, len(whole), TEXTS):
                batch = whole.slice(at, TEXTS)
                fitted, sizes = fit_tokens(tokenizer, [t or "" for t in batch.column(text).to_pylist()], budget)
                prompts = [chat(system, template.replace(PLACEHOLDER, t)) for t in fitted]
                ids = [x.ids for x in encoded(tokenizer, prompts, places=False)]
                added = [pa.array(sizes, pa.int64()), pa.array(fitted, pa.string()), pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), *added], [*(f.name for f in own), *new])

    return df.mapInArrow(run, schema)


def batches_of(lengths: list[int], size: int, by_length: bool = True) -> list[list[int]]:
    """Numbers of rows in batches of at most ``size``, of like lengths, or in order."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)) if by_length else list(range(len(lengths)))
    return [order[i : i + size] for i in range(0, len(order), size)]


def left_padded(ids: list, pad: int):
    """(matrix, mask) of lists of ids, padded on the left to the longest."""
    import numpy as np

    longest = max(map(len, ids), default=0)
    matrix, mask = np.full((len(ids), longest), pad, np.int32), np.zeros((len(ids), longest), np.int8)
    for row, seen, own in zip(matrix, mask, ids):
        if len(own):
            row[-len(own) :] = own
            seen[-len(own) :] = 1
    return matrix, mask


def _held(batches: Iterator, rows: int) -> Iterator:
    """The rows of Arrow batches in record batches of ``rows``, the last one of fewer."""
    import pyarrow as pa

    table = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if table is None else pa.concat_tables([table, pa.Table.from_batches([batch])])
        while len(table) >= rows:
            yield table.slice(0, rows).combine_chunks().to_batches()[0]
            table = table.slice(rows)
    if table is not None and len(table):
        yield table.combine_chunks().to_batches()[0]


def pad_batches(df: DataFrame, batch_size: int = BATCH_SIZE, pad: int = 0, by_length: bool = True, held_batches: int = HELD_BATCHES) -> DataFrame:
    """``df`` (input_ids, ...) with ``batch`` and ``attention_mask``, and ``input_ids`` padded on the left to their batch's longest.

    Rows come back in their order. A task holds ``held_batches`` batches, among which it
    brings rows of like length together; so padding depends on their spread, not on the order of the table.
    """
    own = [f for f in df.schema.fields if f.name not in ("batch", "attention_mask")]
    names = [f.name for f in own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", batch long, attention_mask array<tinyint>"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for part in _held(batches, batch_size * held_batches):
            ids = [x or [] for x in part.column("input_ids").to_pylist()]
            out, masks, of = [None] * len(ids), [None] * len(ids), [0] * len(ids)
            for rows in batches_of([len(x) for x in ids], batch_size, by_length):
                matrix, mask = left_padded([ids[i] for i in rows], pad)
                for i, a, b in zip(rows, matrix, mask):
                    out[i], masks[i], of[i] = a, b, number
                number += 1
            columns = [pa.array(out, pa.list_(pa.int32())) if c == "input_ids" else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(of, pa.int64()), pa.array(masks, pa.list_(pa.int8()))], [*names, "batch", "attention_mask"])

    return df.mapInArrow(run, schema)


def padding_share(padded: DataFrame) -> DataFrame:
    """(n_rows, n_batches, n_ids, n_padding): how much of the padded batches is padding."""
    seen = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return padded.agg(
        F.count("*").alias("n_rows"), F.count_distinct("batch").alias("n_batches"), F.coalesce(F.sum(F.size("attention_mask")), F.lit(0)).alias("n_ids"),
        F.coalesce(F.sum(F.size("attention_mask") - seen), F.lit(0)).alias("n_padding"),
    )


def generate_encoded(
    df: DataFrame, make_model: Callable[[], BatchModel], batch_size: int = BATCH_SIZE, pad: int = 0, into: str = "raw", by_length: bool = True, held_batches: int = HELD_BATCHES
) -> DataFrame:
    """``df`` (input_ids, ...) with the stripped answers of a model that gets batches of left-padded ids and masks; rows keep their order."""
    own = [f for f in df.schema.fields if f.name != into]
    names = [f.name for f in own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + f", `{into}` string"

    def run(batches):
        import pyarrow as pa

        model = make_model()
        for part in _held(batches, batch_size * held_batches):
            ids, answers = [x or [] for x in part.column("input_ids").to_pylist()], [None] * len(part)
            for rows in batches_of([len(x) for x in ids], batch_size, by_length):
                for i, answer in zip(rows, model(*left_padded([ids[i] for i in rows], pad))):
                    answers[i] = None if answer is None else answer.strip()
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(answers, pa.string())], [*names, into])

    return df.mapInArrow(run, schema)
