import hashlib
import random

import pyarrow as pa
import pytest

from quarry.functions.fixed import PROMPT_MARGIN
from quarry.operators import concepts, encoding
from quarry.plans.queries import SYSTEM, token_budget

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [None, "", " ", "a", "é" * 40, "\U0001f600" * 30, "中文字" * 30, "one two  three\n\nfour " * 30, "x" * 500, "<|endoftext|> end"]


@pytest.fixture(scope="module")
def tokenizer():
    return encoding.file_tokenizer(PATH)()


def ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def longest_prefix(tokenizer, text, budget):
    """The longest prefix of whole characters that the first tokens of the whole text hold."""
    found = tokenizer.encode(text, add_special_tokens=False)
    if len(found.ids) <= budget:
        return text
    held = set()
    for i in range(len(text) + 1):
        if sum(1 for a, b in found.offsets if a < i) <= budget:
            held.add(i)
    return text[: max(held)]


@pytest.mark.parametrize("budget", [0, 1, 2, 7, 40])
def test_texts_are_cut_at_the_last_whole_character_within_the_budget(tokenizer, budget):
    texts = [t or "" for t in ODD]
    cut, sizes = encoding.fit_tokens(tokenizer, texts, budget)
    assert sizes == [len(ids(tokenizer, t)) for t in texts]
    for text, got in zip(texts, cut):
        assert got == longest_prefix(tokenizer, text, budget) and text.startswith(got)
        assert "�" not in got and (got == text or len(ids(tokenizer, got)) <= budget)


def test_prompts_fit_and_the_template_is_never_cut(spark, tokenizer):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, fitted string")
    template, room = "Read:\n{txt}\nEnd of the text.", 60
    empty = len(ids(tokenizer, encoding.plain_chat("sys", template.replace("{txt}", ""))))
    for r in encoding.encode_prompts(docs, encoding.file_tokenizer(PATH), "sys", template, room).collect():
        assert r.input_ids == ids(tokenizer, encoding.plain_chat("sys", template.replace("{txt}", r.fitted))) and len(r.input_ids) <= room
        assert r.fitted == longest_prefix(tokenizer, ODD[r.doc_id] or "", room - empty - PROMPT_MARGIN)
        assert tokenizer.decode(r.input_ids).startswith("<|system|>\nsys\n<|user|>\nRead:\n") and tokenizer.decode(r.input_ids).endswith("\nEnd of the text.\n<|assistant|>\n")
    tight = encoding.encode_prompts(docs, encoding.file_tokenizer(PATH), "sys", template, 3).collect()
    assert {r.fitted for r in tight} == {""} and {len(r.input_ids) for r in tight} == {empty}
    assert encoding.encode_prompts(docs.limit(0), encoding.file_tokenizer(PATH), "sys", template).count() == 0
    with pytest.raises(ValueError):
        encoding.encode_prompts(docs, encoding.file_tokenizer(PATH), "sys", "no place")


def test_query_equals_brute_force_counts(spark, sf_dir, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    empty = len(ids(tokenizer, encoding.plain_chat(SYSTEM, "Read: .")))
    budget, rows, cut = 700 - empty - PROMPT_MARGIN, token_budget(spark, sf_dir).collect(), 0
    assert len(rows) == len(docs)
    for r in rows:
        found = tokenizer.encode(docs[r.doc_id], add_special_tokens=False)
        text = docs[r.doc_id]
        if len(found.ids) > budget:
            text, cut = text[: min(found.offsets[budget - 1][1], found.offsets[budget][0])], cut + 1
        assert (r.n_tokens, r.fitted_sha256) == (len(found.ids), hashlib.sha256(text.encode()).hexdigest())
        assert r.n_ids == len(ids(tokenizer, encoding.plain_chat(SYSTEM, f"Read: {text}."))) <= 700
    assert cut


def test_left_padding():
    matrix, mask = encoding.left_padded([[1, 2, 3], [], [4]], 9)
    assert matrix.tolist() == [[1, 2, 3], [9, 9, 9], [9, 9, 4]] and mask.tolist() == [[1, 1, 1], [0, 0, 0], [0, 0, 1]]
    assert encoding.left_padded([], 0)[0].shape == (0, 0)
    assert encoding.batches_of([3, 9, 1, 9, 4], 2) == [[1, 3], [4, 0], [2]] and encoding.batches_of([3, 9, 1], 2, False) == [[0, 1], [2]]


def prompts(spark):
    rng = random.Random(2)
    rows = [(i, [i] * rng.choice([0, 1, 5, 40, 300])) for i in range(400)]
    return rows, spark.createDataFrame(rows, "k long, input_ids array<int>").repartition(3)


def test_batches_of_like_lengths_have_little_padding(spark):
    rows, df = prompts(spark)
    share = {}
    for by_length in (True, False):
        padded = encoding.pad_batches(df, 4, 7, by_length, 16)
        got = padded.collect()
        assert sorted(r.k for r in got) == list(range(400))
        by_batch = {}
        for r in got:
            by_batch.setdefault(r.batch, []).append(r)
            assert r.input_ids == [7] * (len(r.input_ids) - len(rows[r.k][1])) + rows[r.k][1]
            assert r.attention_mask == [0] * (len(r.input_ids) - len(rows[r.k][1])) + [1] * len(rows[r.k][1])
        for x in by_batch.values():
            assert len(x) <= 4 and {len(r.input_ids) for r in x} == {max(len(rows[r.k][1]) for r in x)}
        told = encoding.padding_share(padded).first()
        assert (told.n_rows, told.n_batches) == (400, len(by_batch)) and told.n_ids - told.n_padding == sum(len(x) for _, x in rows)
        share[by_length] = told.n_padding / told.n_ids
    assert share[True] < 0.15 < share[False]


def test_a_model_gets_padded_batches_and_rows_keep_their_order(spark):
    def make():
        def model(matrix, mask):
            assert matrix.shape == mask.shape and len(matrix) <= 4
            return [None if not m.any() else f" {int(r[m == 1][-1])}/{int(m.sum())} " for r, m in zip(matrix, mask)]

        return model

    rows, df = prompts(spark)
    df = df.coalesce(1)
    before = [r.k for r in df.collect()]
    got = encoding.generate_encoded(df, make, 4, held_batches=5).collect()
    assert [r.k for r in got] == before
    assert {r.k: r.raw for r in got} == {k: f"{k}/{len(x)}" if x else None for k, x in rows}


def test_held_batches_lose_nothing():
    batches = [pa.RecordBatch.from_pydict({"a": pa.array(range(i, i + n), pa.int64())}) for i, n in ((0, 3), (3, 0), (3, 7), (10, 1))]
    got = [b.column("a").to_pylist() for b in encoding._held(iter(batches), 4)]
    assert got == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10]] and list(encoding._held(iter([]), 4)) == []


def test_rejected_answers_are_observed_without_a_second_pass(spark):
    good = '{"item_id": 1, "concept_proposed": "low mood, 12", "category": "finding", "evidence": "e"}'
    rows = [(1, good), (2, None), (3, "no json"), (4, good.replace("low mood", "the")), (5, good.replace("finding", "odd")), (6, good)]
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    df = spark.createDataFrame(rows, "k long, raw string").mapInArrow(counted, "k long, raw string")
    found, counts = concepts.counted_concepts(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert sorted(r.k for r in found.collect()) == [1, 6] and calls.value == 6
    assert concepts.counts_table(spark, counts, "a").collect() == [("a", 6, 4)]
    assert sorted(map(tuple, concepts.parse_concepts(df).select("k", "place", "concept").collect())) == [(1, 0, "low mood"), (6, 0, "low mood")]


def test_places_are_asked_for_cut_texts_only():
    from quarry.operators.encoding import fit_tokens

    class Answer:
        def __init__(self, text):
            self.ids = list(range(len(text)))

        @property
        def offsets(self):
            if len(self.ids) <= 4:
                raise AssertionError("places of a text that fits")
            return [(i, i + 1) for i in self.ids]

    class Letters:
        def encode_batch(self, texts, add_special_tokens):
            return [Answer(t) for t in texts]

    assert fit_tokens(Letters(), ["", "abcd", "abcdefg"], 4) == (["", "abcd", "abcd"], [0, 4, 7])
