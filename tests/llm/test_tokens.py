import random
import zlib

import numpy as np
import pytest

from quarry.llm.registry import tokenizer_path
from quarry.llm.tokens import Encoder, read_tokens, write_tokens
from tests.llm.fixtures import documents, empty, whole


def slow(docs):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for d, text, _ in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("data", ["odd", "whole"])
def test_round_trip(spark, sf_dir, tmp_path, data):
    docs = [(r.doc_id, r.text, r.source) for r in documents(spark).collect()] if data == "odd" else whole(spark, sf_dir)
    folder = f"file://{tmp_path}/t"
    manifest = write_tokens(documents(spark, docs), folder, tokenizer_path(), partitions=5)
    assert manifest["docs"] == len(docs)
    assert sorted(map(tuple, read_tokens(spark, folder).collect()), key=lambda r: r[1]) == slow(docs)
    assert not list(tmp_path.glob("t/.part*"))


def test_empty(spark, tmp_path):
    assert write_tokens(empty(spark), str(tmp_path / "e"), tokenizer_path())["ids"] == 0
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("text", [
    "a  b", "a   b", " a", "a ", "a \n b", "x\n\n y", "x \n\ny", "\n x", "it's 's a 'll", "a  b", "a 　c", "éa 12 3a!! ??\t q", "<|endoftext|> a", "a <|endoftext|>b", " ", "  ", "\n", "a \n", "a\r\n b",
])
def test_pieces_equal_whole_texts(text):
    encoder = Encoder(tokenizer_path())
    for _ in range(2):
        assert list(np.frombuffer(encoder.encode(text), encoder.dtype)) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_random_texts_equal_the_tokenizer():
    """Any mixture of letters, marks, white space, endings and characters of other scripts, in one store."""
    import pyarrow as pa

    rng = random.Random(3)
    marks = [*map(chr, range(0x250)), *"’—中\U0001f600́٠ 　​﻿  ", *" " * 60, *"'" * 10, *"\n" * 20, *"abstrevldm" * 8, "  ", "\t", " \n", "<|endoftext|>", " 's", "'re"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(8000)] + [None, "", "'", "''s", "a'", "a'l", "é"]
    encoder, at = Encoder(tokenizer_path()), 0
    ids, counts = encoder.encode_all(pa.array(texts))
    for text, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2], text
        at += n
    assert at == len(ids)


def test_one_id_fills_several_files(spark, tmp_path):
    docs = documents(spark, [(7, f"text {i % 3}", "a") for i in range(300)] + [(None, "x", "a")] * 50)
    manifest = write_tokens(docs, f"{tmp_path}/t", tokenizer_path(), partitions=6)
    assert manifest["docs"] == 350 and manifest["parts"] >= 5
    rows = sorted(map(tuple, read_tokens(spark, f"{tmp_path}/t").collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None] * 50 + [7] * 300
    assert [r[1] for r in rows] == [sum(r[2] for r in rows[:i]) for i in range(350)]


def test_bases_are_prefix_sums_over_groups_of_files(spark):
    from quarry.llm import tokens

    n = 2 * tokens.GROUP + 5
    written = spark.range(n).selectExpr("id AS part", "concat('p', id) AS name", "2 AS width", "id % 7 AS docs", "id % 11 AS ids")
    got = tokens._with_bases(written).orderBy("part").select("first_doc", "first_id").collect()
    docs = ids = 0
    for i, row in enumerate(got):
        assert tuple(row) == (docs, ids)
        docs, ids = docs + i % 7, ids + i % 11
