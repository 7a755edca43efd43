"""Token-id output: flat unsigned integer files with 64-bit document offsets.

A partition holds a range of doc_ids in ascending order and writes three files as
its rows stream in: ``.bin`` (ids, uint16 or uint32 by the vocabulary's size),
``.idx`` (uint64 offsets of its documents in ids, one more than documents) and
``.doc`` (int64 doc_ids). The table ``manifest`` has each partition's base: the
prefix sums of ids and documents before it, added up in the cluster. A file is
written under a name of its own and then moved to its final name, so a task that
runs again or twice leaves the same files. They are read back memory-mapped where
the folder is a local one, and by range otherwise.

Defined results: a null text is empty and has the end id alone; a null doc_id is
stored as the smallest int64 and comes back as null, first in order; repeated
rows are written as often as they occur; rows of one doc_id are ordered by a hash
of the text and may fill several files; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = 2

#: Bytes of text that a partition gets on average.
PART_BYTES = 24 << 20

#: Units of text after which a worker starts a new store; it keeps the one before as well.
CACHED = 500_000

NO_ID = -(1 << 63)


def _fs(path: str):
    """The file system of a path or URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(folder: str, name: str, begin: int = 0, end: int | None = None):
    """The bytes of a file, or of a part of it; memory-mapped where that is possible."""
    import pyarrow as pa
    from pyarrow import fs

    where, path = _fs(folder)
    path = f"{path}/{name}"
    if isinstance(where, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()[begin:end] if os.path.getsize(path) else b""
    with where.open_input_file(path) as f:
        return f.read_at((f.size() if end is None else end) - begin, begin)


#: Bytes of text that are encoded at once, and units that the tokenizer gets in one string.
HELD, JOINED = 8 << 20, 25

#: Kinds of characters; those from U+0250 on are FAR. A character's first byte has its kind, the others REST.
REST, LETTER, NUMBER, OTHER, SPACE, WHITE, FAR = range(7)
_PLAIN = 0x250

#: Endings that a byte-level tokenizer splits off with their apostrophe (fixed values).
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


@functools.lru_cache(maxsize=1)
def _kinds():
    """The kind of each character below _PLAIN."""
    import unicodedata

    import numpy as np

    by_group = {"L": LETTER, "N": NUMBER}
    kinds = np.array([by_group.get(unicodedata.category(chr(c))[0], OTHER) for c in range(_PLAIN)], np.uint8)
    kinds[[*range(9, 14), 0x85, 0xA0]] = WHITE
    kinds[0x20] = SPACE
    return kinds


def units_of(texts):
    """(units, firsts): an Arrow array of the units of all ``texts``, and where those of each text begin (one more than texts).

    A unit ends only where the tokenizer's own pre-tokens end: between letters,
    numbers and other characters, with one space before them, and around white
    space. In a text with characters from U+0250 on, whose kinds aren't told here,
    units end only before single spaces between plain characters.
    """
    import numpy as np
    import pyarrow as pa

    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = int(offsets[0])
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low : int(offsets[-1])]
    begins = offsets - low
    kinds = _kinds()
    by_byte = np.concatenate([kinds[:0x80], np.full(0x40, REST, np.uint8), np.full(0x40, FAR, np.uint8)])
    kind = by_byte[raw]
    two = np.flatnonzero((raw >= 0xC2) & (raw <= 0xC9))
    code = (raw[two] & 0x1F).astype(np.int64) << 6 | raw[two + 1] & 0x3F
    kind[two] = np.append(kinds, FAR)[np.minimum(code, _PLAIN)]
    at = np.flatnonzero(kind)  # the first bytes of characters
    k, byte = kind[at], np.append(raw[at], np.zeros(3, np.uint8))
    first = np.searchsorted(at, begins)  # characters before each text
    filled = np.flatnonzero(np.diff(first))
    head, last = first[filled], first[filled + 1] - 1
    seen = (k >= LETTER) & (k <= OTHER)
    before, after = np.roll(k, 1), np.roll(seen, -1)
    after[last] = False
    start = np.where(seen, (before != k) & (before != SPACE), np.roll(seen, 1) | after)
    start[head] = True

    marks = np.flatnonzero((byte[: len(k)] == 0x27) & start)
    if len(marks):
        end = last[np.searchsorted(head, marks, "right") - 1]
        for x in ENDINGS:
            hit = (marks + len(x) <= end) & (byte[marks + 1] == x[0]) & (byte[marks + len(x)] == x[-1])
            start[marks[hit] + 1] = False
            then = marks[hit] + len(x) + 1
            start[then[then <= end[hit]]] = True
    for i in np.unique(np.searchsorted(head, np.flatnonzero(k == FAR), "right") - 1).tolist():
        own = slice(head[i], last[i] + 1)
        start[own] = (k[own] == SPACE) & np.roll(seen[own], 1) & np.roll(seen[own], -1)
        start[head[i]] = True
    cuts = np.append(at[start], len(raw))
    units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw))
    return units, np.searchsorted(cuts[:-1], begins)


class Encoder:
    """Ids of whole texts by a tokenizer file, with a bounded store of the units of a text.

    For byte-level BPE a text is cut into units at places where the tokenizer's own
    pre-tokens end. What a unit's ids are is always answered by the tokenizer,
    which gets new units joined by tabs and splits and merges them itself; equal
    units are told apart and put together for many texts at once. Texts with
    special tokens' strings, and other kinds of tokenizers, go through it whole.
    """

    def __init__(self, path: str, end: int = END):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if max(self.size, end + 1) <= 1 << 16 else "<u4"
        self.end = end
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        self.by_units = (
            kind["normalizer"] is None and kind["model"]["type"] == "BPE" and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
        )
        tab = self.tokenizer.encode("\t", add_special_tokens=False).ids if self.by_units else []
        self.by_units &= len(tab) == 1
        self.tab = tab[0] if tab else None

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _stored(self, unit: str) -> bytes | None:
        ids = self.young.get(unit)
        if ids is None and (ids := self.old.get(unit)) is not None:
            self.young[unit] = ids
        return ids

    def _learn(self, units: list[str]) -> None:
        """Store the ids of new units: the tokenizer gets them joined by tabs, which its own splits keep apart."""
        import numpy as np

        joined = [u for u in units if not ("\t" in u or u[-1].isspace())]
        for at in range(0, len(joined), JOINED * 40):
            parts = [joined[i : i + JOINED] for i in range(at, min(at + JOINED * 40, len(joined)), JOINED)]
            for part, found in zip(parts, self.tokenizer.encode_batch_fast(["\t".join(x) for x in parts], add_special_tokens=False)):
                ids = np.array(found.ids, self.dtype)
                cuts = np.flatnonzero(ids == self.tab).tolist()
                if len(cuts) == len(part) - 1:
                    raw, width = ids.tobytes(), ids.itemsize
                    starts = [0, *((c + 1) * width for c in cuts)]
                    ends = [*(c * width for c in cuts), len(raw)]
                    self.young.update(zip(part, (raw[a:b] for a, b in zip(starts, ends))))
        for u in units:
            if u not in self.young:
                self.young[u] = self._whole(u)

    def _ids(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units."""
        out = list(map(self._stored, units))
        new = [i for i, ids in enumerate(out) if ids is None]
        self._learn([units[i] for i in new])
        for i in new:
            out[i] = self.young[units[i]]
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        return out

    def encode_all(self, texts):
        """(ids, counts) of an Arrow array of texts: all ids in order, each text's followed by the end id, and their numbers."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        tail = np.array([self.end], self.dtype).tobytes()
        if not self.by_units:
            found = [self._whole(t) + tail for t in texts.to_pylist()]
            return np.frombuffer(b"".join(found), self.dtype), np.array([len(x) // len(tail) for x in found], np.int64)

        special = np.zeros(n, bool)
        for t in self.special:
            special |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(special)
        units, firsts = units_of(texts)
        coded = units.dictionary_encode()
        found = self._ids(coded.dictionary.to_pylist())
        # Each unit's entry in found; a text taken whole has one entry, and the end's goes after each text.
        entry, keep = coded.indices.to_numpy().astype(np.int64), np.ones(len(units), bool)
        for i in whole.tolist():
            keep[firsts[i] + 1 : firsts[i + 1]] = False
            entry[firsts[i]] = len(found)
            found.append(self._whole(texts[i].as_py()))
        found.append(tail)
        entry = np.insert(entry, firsts[1:], len(found) - 1)[np.insert(keep, firsts[1:], True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // len(tail)
        flat = np.frombuffer(b"".join(found), self.dtype)
        many, place = sizes[entry], np.cumsum(sizes[entry])
        ids = flat[np.repeat(np.cumsum(sizes)[entry] - place, many) + np.arange(place[-1])]
        return ids, np.diff(place[entry == len(found) - 1], prepend=0)

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian integers, without the end id."""
        import pyarrow as pa

        return self.encode_all(pa.array([text], pa.large_string()))[0][:-1].tobytes()


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, end: int) -> Encoder:
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def _slices(batch):
    """Parts of an Arrow batch with about HELD bytes of text each; a longer text is a part of its own."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + HELD, "right")))
        yield batch.slice(at, to - at)
        at = to


class _Part:
    """The three files of a partition, written as its rows stream in and named once they are whole."""

    def __init__(self, folder: str, name: str):
        self.fs, self.path = _fs(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.final = {kind: f"{self.path}/{name}.{kind}" for kind in ("bin", "idx", "doc")}
        self.draft = {kind: f"{self.path}/.{name}.{kind}.{uuid.uuid4().hex}" for kind in self.final}
        self.out = {kind: self.fs.open_output_stream(path) for kind, path in self.draft.items()}

    def close(self) -> None:
        from pyarrow import fs

        for kind, out in self.out.items():
            out.close()
            # Some stores refuse to rename onto a file, as one that a lost executor has left.
            if self.fs.get_file_info(self.final[kind]).type != fs.FileType.NotFound:
                self.fs.delete_file(self.final[kind])
            self.fs.move(self.draft[kind], self.final[kind])


#: Partitions whose sums are added up in one task before the sums of such groups are.
GROUP = 4096


def _with_bases(written: DataFrame) -> DataFrame:
    """``written`` with first_doc and first_id: prefix sums within groups of partitions, and over the groups."""
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = written.withColumn("grp", F.floor(F.col("part") / GROUP))
    sums = grouped.groupBy("grp").agg(F.sum("docs").alias("d"), F.sum("ids").alias("i"))
    over = Window.orderBy("grp")
    sums = sums.select(F.col("grp"), before("d", over).alias("base_doc"), before("i", over).alias("base_id"))
    own = Window.partitionBy("grp").orderBy("part")
    inside = grouped.withColumns({"first_doc": before("docs", own), "first_id": before("ids", own)})
    return inside.join(sums, "grp").select("part", "name", "width", "docs", "ids", (F.col("first_doc") + F.col("base_doc")).alias("first_doc"), (F.col("first_id") + F.col("base_id")).alias("first_id"))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END, partitions: int | None = None) -> dict:
    """Write ``docs`` (doc_id, text) below ``folder`` and return the numbers of files, documents and ids."""
    spark = docs.sparkSession

    def write(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        encoder, part, n_docs, n_ids = _encoder(tokenizer, end), None, 0, 0
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}"
        for batch in batches:
            for piece in _slices(batch):
                if part is None:
                    part = _Part(folder, name)
                    part.out["idx"].write(np.zeros(1, "<u8").tobytes())
                ids, counts = encoder.encode_all(piece.column("text"))
                part.out["bin"].write(ids.tobytes())
                part.out["idx"].write((n_ids + np.cumsum(counts)).astype("<u8").tobytes())
                part.out["doc"].write(pc.fill_null(piece.column("doc_id"), NO_ID).to_numpy().astype("<i8").tobytes())
                n_docs, n_ids = n_docs + len(counts), n_ids + len(ids)
        if part is None:
            return
        part.close()
        width = np.dtype(encoder.dtype).itemsize
        yield pa.RecordBatch.from_pydict({"part": [number], "name": [name], "docs": [n_docs], "ids": [n_ids], "width": [width]})

    if partitions is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(2 * spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    # The text's hash and the row's place part rows of one id, so no id fills a file.
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("place")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(write, "part long, name string, docs long, ids long, width long").write.parquet(f"{folder}/written")
    _with_bases(spark.read.parquet(f"{folder}/written")).write.parquet(f"{folder}/manifest")
    parts, n_docs, n_ids = spark.read.parquet(f"{folder}/manifest").agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("ids"), F.lit(0))).first()
    return {"end": end, "parts": parts, "docs": n_docs, "ids": n_ids}


#: Documents of a file that are read at once.
ROWS = 10_000


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    parts = spark.read.parquet(f"{folder}/manifest").select("name", "width", "first_id")

    def load(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in batch.to_pylist():
                cuts = np.frombuffer(_read(folder, part["name"] + ".idx"), "<u8").astype(np.int64)
                names = np.frombuffer(_read(folder, part["name"] + ".doc"), "<i8")
                for a in range(0, len(names), ROWS):
                    b = min(a + ROWS, len(names))
                    ids = np.frombuffer(_read(folder, part["name"] + ".bin", int(cuts[a]) * part["width"], int(cuts[b]) * part["width"]), f"<u{part['width']}")
                    own = cuts[a : b + 1] - cuts[a]
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(own, own[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[a:b], mask=names[a:b] == NO_ID), pa.array(cuts[a:b] + part["first_id"]), pa.array(np.diff(own)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = parts.count()
    dealt = parts.repartition(max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, n // 16))))
    return dealt.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")
