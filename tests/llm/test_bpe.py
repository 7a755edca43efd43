import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import bpe
from quarry.llm.registry import op12_bpe, tokenizer_path
from tests.llm.fixtures import documents, empty, whole

ODD = [
    "a  b", " a", "a ", "a \n b", "x\n\n y", "x \n\ny", "x\n\ny", "\n x", "it's 's a 'll", "!'s ''re 1's é's", "a　b　 c", "éa 12 3a!! ??\t q", "<|endoftext|> a", "a <|endoftext|>b", " ", "\n\n", "a\r\n b",
    "#'s", "##'re", "x'x'x", "'", "''", "it's'", "  x", "中文字 中文，字", "ßàöü" * 3, "\U0001f600\U0001f600 á́", "\x85 x\x85\x85y", "\x1c\x1dz", "\x00\x01",
]


@pytest.fixture(scope="module")
def coder():
    return bpe.ForcedBoundaryBPE(tokenizer_path())


def plain(coder, text):
    return coder.tokenizer.encode(text or "", add_special_tokens=False).ids


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_odd_texts_equal_the_tokenizer(coder):
    decoder = bpe.Decoder(tokenizer_path())
    for _ in range(2):
        for text, raw in zip([*ODD, None, ""], coder.encode_all(pa.array([*ODD, None, ""]))):
            assert ids_of(raw) == plain(coder, text), text
            assert decoder(raw) == coder.tokenizer.decode(plain(coder, text), skip_special_tokens=False) == (text or "")


def test_random_texts_equal_the_tokenizer(coder):
    rng = random.Random(9)
    marks = [*map(chr, range(0x250)), *"’—中\U0001f600́٠ 　​﻿  ", *" " * 60, *"'" * 25, *"\n" * 20, *"abstrevldm" * 8, "  ", "\t", " \n", "<|endoftext|>", " 's", "'re", "!'", "1'"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(12000)]
    for text, raw in zip(texts, coder.encode_all(pa.array(texts))):
        assert ids_of(raw) == plain(coder, text), text


def test_fragments_end_only_at_pairs_inside_no_token(coder):
    """The cuts carry the work: prose falls into fragments, no token spans two, and each encodes alone as within the text."""
    text = "The quick, brown fox (it's 42) ßx jumped\nover 'the' lazy dogs' naïve façade."
    fragments, firsts = coder.fragments_of(pa.array([text], pa.large_string()))
    parts = fragments.to_pylist()
    assert "".join(parts) == text and firsts.tolist() == [0, len(parts)] and len(parts) > 15
    tokens = [bpe.token_bytes(t) for t in coder.tokenizer.get_vocab()]
    inside = {t[i : i + 2] for t in tokens for i in range(len(t) - 1)}
    for a, b in zip(parts, parts[1:]):
        assert a.encode()[-1:] + b.encode()[:1] not in inside
    assert [i for p in parts for i in plain(coder, p)] == plain(coder, text)


def test_whole_tables_equal_the_tokenizer(spark, sf_dir, coder):
    got = {r.doc_id: r for r in op12_bpe(spark, sf_dir).collect()}
    docs = whole(spark, sf_dir)
    assert len(got) == len(docs)
    for doc_id, text, _ in docs:
        ids, r = plain(coder, text), got[doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(coder.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_and_small_store(spark, coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    small = bpe.ForcedBoundaryBPE(tokenizer_path())
    rows = documents(spark).collect()
    for r, raw in zip(rows, small.encode_all(pa.array([r.text for r in rows]))):
        assert ids_of(raw) == plain(coder, r.text)
    got = bpe.decode(bpe.encode(documents(spark), tokenizer_path()), tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((r.doc_id or 0, r.text or "") for r in rows)
    assert bpe.encode(empty(spark), tokenizer_path()).count() == 0


def test_decoding_of_any_ids(coder):
    decoder, rng = bpe.Decoder(tokenizer_path()), random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert decoder(np.array(ids, "<u4").tobytes()) == coder.tokenizer.decode(ids, skip_special_tokens=False)
    assert decoder(np.array([64, 70000, 65], "<u4").tobytes()) == coder.tokenizer.decode([64, 65])


def test_other_tokenizers_are_given_whole_texts():
    other = bpe.ForcedBoundaryBPE(tokenizer_path("word_bpe_49k.json"))
    assert not other.by_fragments and [ids_of(x) for x in other.encode_all(pa.array(["The fox", None]))] == [plain(other, "The fox"), []]
