"""BPE encoding by forced boundaries, and decoding.

Two bytes that are neighbours inside no token of the vocabulary are never in one token
of any text, so each such pair marks a certain cut: merges to its left and right don't
touch each other, and what lies between cuts is encoded by itself and put together
again. Texts are made of few different fragments, so a worker keeps a bounded store of
fragments' ids and asks the tokenizer for new ones only.

A byte-level tokenizer first splits a text by a pattern that looks at kinds of
characters. A cut is left out where splitting what follows by itself could differ:
inside a character, after white space (whose runs are split by what follows them), and
beside an apostrophe unless an ASCII letter or digit is before it. All other cuts are
either ends of the pattern's own matches or inside a run of one kind, which goes on alike.

Defined results: a null text is empty; empty texts have no ids; texts with a special
token's string, and all texts where the tokenizer isn't a plain byte-level BPE, are
given to the tokenizer whole; a null doc_id stays null; repeated rows come back as
often as they occur; other columns are ignored; an empty table gives an empty result.
Ids of no token are left out in decoding, and bytes that aren't UTF-8 become U+FFFD.
"""

from __future__ import annotations

import functools
import json
import os

from pyspark.sql import DataFrame

#: Bytes of text that are encoded at once.
HELD = 4 << 20

#: Fragments after which a worker starts a new store; it keeps the one before as well.
CACHED = 400_000

#: New fragments that the tokenizer gets in one string.
JOINED = 25

#: Endings that a byte-level tokenizer splits off with their apostrophe (fixed values).
ENDINGS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")


@functools.lru_cache(maxsize=1)
def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def token_bytes(token: str) -> bytes:
    """The bytes of a token; one with a character that stands for no byte is taken as it is."""
    known = byte_of()
    return bytes(map(known.__getitem__, token)) if all(c in known for c in token) else token.encode()


class ForcedBoundaryBPE:
    """Ids of texts by a tokenizer file, encoded fragment by fragment between forced boundaries."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.to_str())
        before, model = kind["pre_tokenizer"] or {}, kind["model"]
        self.by_fragments = (
            kind["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout") and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
        )
        self.never = self._never_inside(model["vocab"]) if self.by_fragments else None
        tab = self.tokenizer.encode("\t", add_special_tokens=False).ids
        self.tab = tab[0] if self.by_fragments and len(tab) == 1 and self.never[9].all() and self.never[:, 9].all() else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _never_inside(vocabulary):
        """Whether two bytes are neighbours inside no token, as a table by first and second byte."""
        import numpy as np

        never = np.ones((256, 256), bool)
        for token in [*map(token_bytes, vocabulary), *ENDINGS]:
            never[list(token[:-1]), list(token[1:])] = False
        return never

    def fragments_of(self, texts):
        """(fragments, firsts): an Arrow array of the fragments of all ``texts``, and where those of each text begin (one more than texts)."""
        import numpy as np
        import pyarrow as pa

        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low = int(offsets[0])
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low : int(offsets[-1])]
        begins = offsets - low
        a, b = raw[:-1], raw[1:]
        cut = self.never[a, b] & ((b & 0xC0) != 0x80) & (a > 0x20) & (a != 0x27)
        word = np.zeros(256, bool)
        word[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        cut &= (b != 0x27) | word[a]
        # White space beyond ASCII: the characters whose first byte is one of these are left uncut behind.
        far = np.flatnonzero(cut & (a >= 0x80))
        if len(far):
            lead = raw[np.maximum(far - 2, 0)]
            cut[far[(raw[np.maximum(far - 1, 0)] == 0xC2) | (lead >= 0xE1) & (lead <= 0xE3)]] = False
        starts = np.zeros(len(raw) + 1, bool)
        starts[1:-1] = cut
        starts[begins] = True
        starts[-1] = False
        at = np.flatnonzero(starts)
        fragments = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw))), pa.py_buffer(raw))
        return fragments, np.searchsorted(at, begins)

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Store the ids of new fragments. Tabs are in no longer token, so between fragments they are cuts themselves."""
        import numpy as np

        joined = [x for x in new if "\t" not in x and not x[-1].isspace()] if self.tab is not None else []
        groups = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(["\t".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            tabs = np.flatnonzero(ids == self.tab).tolist()
            if len(tabs) == len(group) - 1:
                raw = ids.tobytes()
                self.young.update((x, raw[4 * a : 4 * b]) for x, a, b in zip(group, [0, *(t + 1 for t in tabs)], [*tabs, len(ids)]))
        for x in new:
            if x not in self.young:
                self.young[x] = self._whole(x)

    def _ids(self, fragments: list[str]) -> list[bytes]:
        """The ids of different fragments."""
        out, new = [], []
        for x in fragments:
            ids = self.young.get(x)
            if ids is None and (ids := self.old.get(x)) is not None:
                self.young[x] = ids
            if ids is None:
                new.append(x)
            out.append(ids)
        if new:
            self._learn(new)
            out = [self.young[x] if ids is None else ids for x, ids in zip(fragments, out)]
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        return out

    def encode_all(self, texts) -> list[bytes]:
        """The ids of each of an Arrow array of texts, as little-endian unsigned 32-bit integers."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_fragments:
            return [self._whole(t) for t in texts.to_pylist()]
        if not len(texts):
            return []
        fragments, firsts = self.fragments_of(texts)
        coded = fragments.dictionary_encode()
        found, firsts = self._ids(coded.dictionary.to_pylist()), firsts.tolist()
        each = list(map(found.__getitem__, coded.indices.to_pylist()))
        out = [b"".join(each[a:b]) for a, b in zip(firsts, firsts[1:])]
        for token in self.special:
            for i, hit in enumerate(pc.match_substring(texts, token).to_pylist()):
                if hit:
                    out[i] = self._whole(texts[i].as_py())
        return out


class Decoder:
    """Texts of ids by a byte-level tokenizer file; special tokens are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        kind = json.loads(tokenizer.to_str())
        if (kind["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("the tokenizer's decoder isn't a byte-level one")
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token_bytes(token)

    def __call__(self, ids: bytes | None) -> str:
        import numpy as np

        own = np.frombuffer(ids or b"", "<u4")
        return b"".join(map(self.bytes.__getitem__, own[own < len(self.bytes)].tolist())).decode("utf-8", "replace")


_made: dict[tuple, object] = {}


def _made_once(kind, path: str):
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]


def _pieces(batch, column: str):
    """Parts of an Arrow batch with about HELD bytes of ``column`` each; a longer value is a part of its own."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + HELD, "right")))
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text): ids as little-endian unsigned 32-bit integers; a narrow pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        encoder = _made_once(ForcedBoundaryBPE, tokenizer)
        for batch in batches:
            for part in _pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encoder.encode_all(part.column("text")), pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``encoded`` (doc_id, ids), a narrow pass; null ids are none."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        decoder = _made_once(Decoder, tokenizer)
        for batch in batches:
            for part in _pieces(batch, "ids"):
                texts = [decoder(x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
