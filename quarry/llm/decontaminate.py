"""Benchmark decontamination with a positional inverted index.

The index is built once from the training documents alone and written to the
shared folder: each shard, of some documents, holds the postings of all their
tokens as one list of places for each term. Any benchmark can be looked up in it.
A window of test words is matched by taking the list of the term that is rarest in
the shard, moving it by that term's offset, and intersecting it with the moved
lists of the next rarest terms. What is left are exact phrases; lists that meet
within ``slop`` places of where each term should be are proximity matches.

Test items are taken in blocks of a bounded number of windows, so what a worker
holds doesn't grow with the benchmark; the results of blocks are merged.

Defined results: a null or word-less text has no words and no hits; a null or
word-less item matches nothing; an item with a null id marks words but isn't
listed; repeated items count once; repeated rows get equal results; other
columns are ignored, and carried unchanged by :func:`drop_contaminated` whatever
their names; empty tables give an empty result or no hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ROW_KEY, checkpoint, look_up, new_path, row_key, rows_in

WINDOW, SLOP = 10, 2

#: Windows in a block of test items; a single item with more of them is a block of its own.
BLOCK_WINDOWS = 100_000

#: Postings of a shard; a longer document is a shard of its own.
POSTINGS = 400_000

_WORD = [b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80]
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def words(raw: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case."""
    return raw.translate(_TABLE).split() if raw else []


class Block:
    """Test windows in a form that is sent to workers."""

    def __init__(self, size: int):
        self.size = size
        self.windows: dict[tuple[bytes, ...], set[str | None]] = {}

    def add(self, item_id: str | None, own: list[bytes]) -> None:
        for i in range(max(1, len(own) - self.size + 1)) if own else ():
            self.windows.setdefault(tuple(own[i : i + self.size]), set()).add(item_id)

    def packed(self) -> dict:
        import numpy as np

        vocabulary: dict[bytes, int] = {}
        ids = [[vocabulary.setdefault(w, len(vocabulary)) for w in window] for window in self.windows]
        lengths = np.array([len(x) for x in ids], np.int64)
        terms = np.full((len(ids), lengths.max(initial=1)), -1, np.int64)
        for row, x in zip(terms, ids):
            row[: len(x)] = x
        return {"vocabulary": vocabulary, "terms": terms, "lengths": lengths, "items": [sorted(x for x in v if x is not None) for v in self.windows.values()]}


def blocks(items: DataFrame, size: int = WINDOW, most: int = BLOCK_WINDOWS):
    """Blocks of the test items, read one by one from the cluster."""
    block = Block(size)
    for item_id, text in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        block.add(item_id, words(text.encode() if text else None))
        if len(block.windows) >= most:
            yield block.packed()
            block = Block(size)
    if block.windows:
        yield block.packed()


def build_index(docs: DataFrame) -> DataFrame:
    """(docs, terms, ends, places) of each shard.

    ``docs`` are its documents with their number of words, ``terms`` its words
    joined by spaces, ``ends`` where each term's list ends in ``places``, which
    counts words from the shard's first (both little-endian int32).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def index(batches):
        import itertools
        from collections import defaultdict

        import numpy as np
        import pyarrow as pa

        def shard(batch, at, counts, parts, vocabulary):
            ids = np.concatenate(parts)
            places = np.argsort(ids, kind="stable").astype("<i4")
            own = pa.StructArray.from_arrays([batch.column("doc_id").slice(at, len(counts)), batch.column("row_key").slice(at, len(counts)), pa.array(counts, pa.int64())], ["doc_id", "row_key", "n_words"])
            ends = np.cumsum(np.bincount(ids, minlength=len(vocabulary))).astype("<i4")
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), own), pa.array([b" ".join(vocabulary)], pa.binary()), pa.array([ends.tobytes()], pa.binary()), pa.array([places.tobytes()], pa.binary())],
                ["docs", "terms", "ends", "places"],
            )

        for batch in batches:
            at, held, counts, parts, vocabulary = 0, 0, [], [], defaultdict(itertools.count().__next__)
            for i, raw in enumerate(batch.column("text").cast(pa.large_binary())):
                own = words(raw.as_py())
                if counts and held + len(own) > POSTINGS:
                    yield shard(batch, at, counts, parts, vocabulary)
                    at, held, counts, parts, vocabulary = i, 0, [], [], defaultdict(itertools.count().__next__)
                parts.append(np.fromiter(map(vocabulary.__getitem__, own), np.int64, len(own)))
                counts.append(len(own))
                held += len(own)
            if counts:
                yield shard(batch, at, counts, parts, vocabulary)

    own = docs.select("doc_id", row_key().alias("row_key"), "text")
    return own.mapInArrow(index, f"docs array<struct<doc_id:{kind},row_key:{ROW_KEY},n_words:bigint>>, terms binary, ends binary, places binary")


def intersect(block: dict, terms: bytes, ends, places, begins, slop: int):
    """(doc, window, start, exact) of the matches in a shard whose documents begin at ``begins`` (one more than documents)."""
    import itertools

    import numpy as np

    vocabulary, wanted, lengths = block["vocabulary"], block["terms"], block["lengths"]
    found = terms.split(b" ") if terms else []
    known = np.fromiter(map(vocabulary.get, found, itertools.repeat(-1)), np.int64, len(found))
    hit = np.flatnonzero(known >= 0)
    hit = hit[np.argsort(known[hit], kind="stable")]
    ends = ends.astype(np.int64)
    size = np.diff(ends, prepend=0)[hit]
    lists = places[np.repeat(ends[hit] - np.cumsum(size), size) + np.arange(size.sum())].astype(np.int64)
    sizes = np.zeros(len(vocabulary), np.int64)
    sizes[known[hit]] = size
    tops = np.cumsum(sizes)
    gap = 1 << 32
    keyed = np.repeat(known[hit], size) * gap + lists  # ascending: lists by term, places in each

    none = np.iinfo(np.int64).max
    list_size = np.where(wanted >= 0, sizes[wanted], none)
    rows = np.flatnonzero(list_size.min(axis=1, initial=none) > 0)
    rarest = np.argsort(list_size[rows], axis=1, kind="stable")
    anchor = rarest[:, 0]
    many = list_size[rows, anchor]
    pick = np.repeat(np.arange(len(rows)), many)
    place = lists[np.repeat(tops[wanted[rows, anchor]] - np.cumsum(many), many) + np.arange(many.sum())]
    # The anchor may be moved like any other term, so a match doesn't depend on which term is rarest in the shard.
    moved = np.tile(np.arange(-slop, slop + 1), len(place))
    pick, place = np.repeat(pick, 2 * slop + 1), np.repeat(place, 2 * slop + 1)
    doc = np.searchsorted(begins, place, "right") - 1
    start, exact = place - anchor[pick] + moved, moved == 0
    for step in range(1, wanted.shape[1]):
        more = lengths[rows[pick]] > step
        offset = rarest[pick, step]
        term = np.maximum(wanted[rows[pick], offset], 0)
        near = np.zeros(len(pick), bool)
        for shift in sorted(range(-slop, slop + 1), key=abs):
            to = start + offset + shift
            at = np.minimum(np.searchsorted(keyed, term * gap + to), len(keyed) - 1)
            met = (to >= begins[doc]) & (to < begins[doc + 1]) & (keyed[at] == term * gap + to)
            if not shift:
                exact &= met | ~more
            near |= met
        left = near | ~more
        pick, start, exact, doc = pick[left], start[left], exact[left], doc[left]
    return doc, rows[pick], start - begins[doc], exact


def _merged(starts, ends):
    """Disjoint ascending spans with the same union."""
    import numpy as np

    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def matches(index: DataFrame, block, slop: int) -> DataFrame:
    """(row_key, spans, items, near_items) for each document with a match; spans are [start, end) in words."""

    def match(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column("docs")[i].values
                counts = docs.field("n_words").to_numpy()
                begins = np.concatenate([[0], np.cumsum(counts)])
                ends, places = (np.frombuffer(batch.column(c)[i].as_py(), "<i4") for c in ("ends", "places"))
                d, w, start, exact = intersect(block.value, batch.column("terms")[i].as_py(), ends, places, begins, slop)
                if not len(d):
                    continue
                order = np.argsort(d, kind="stable")
                d, w, start, exact = d[order], w[order], start[order], exact[order]
                cuts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                out: dict[str, list] = {"spans": [], "items": [], "near_items": []}
                for a, b in zip(cuts, [*cuts[1:], len(d)]):
                    own = exact[a:b]
                    s = start[a:b][own]
                    spans = _merged(s, s + block.value["lengths"][w[a:b][own]]) if len(s) else ([], [])
                    name = lambda ws: sorted({x for i in ws for x in block.value["items"][i]})
                    out["spans"].append([{"s": int(x), "e": int(y)} for x, y in zip(*spans)])
                    out["items"].append(name(np.unique(w[a:b][own])))
                    out["near_items"].append(name(np.unique(w[a:b])))
                keys = docs.field("row_key").take(pa.array(d[cuts]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(out["spans"], span), pa.array(out["items"], names), pa.array(out["near_items"], names)], ["row_key", "spans", "items", "near_items"])

    import pyarrow as pa

    names = pa.list_(pa.string())
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    return index.mapInArrow(match, f"row_key {ROW_KEY}, spans array<struct<s:long,e:long>>, items array<string>, near_items array<string>")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(doc_id, row_key, n_words, n_hit, items, near_items) for every row of ``docs``."""
    spark = docs.sparkSession
    path = new_path(spark, "postings")
    build_index(docs).write.parquet(path)
    index = spark.read.parquet(path)
    rows = index.select(F.explode("docs").alias("d")).select("d.doc_id", "d.row_key", "d.n_words")
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<string>")
    found = None
    for packed in blocks(items, size):
        # Copies of a row give the same matches, of which one is kept.
        part = matches(index, spark.sparkContext.broadcast(packed), slop).dropDuplicates(["row_key"])
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("*", zero.alias("n_hit"), empty.alias("items"), empty.alias("near_items"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    by_row = found.groupBy("row_key").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), union("items").alias("items"), union("near_items").alias("near_items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to")),
        lambda acc: acc["n"],
    )
    by_row = checkpoint(by_row.select("row_key", covered.alias("n_hit"), "items", "near_items"))
    return look_up(rows, by_row, "row_key").select(
        "doc_id", "row_key", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", empty).alias("items"), F.coalesce("near_items", empty).alias("near_items")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of a test item occurs."""
    hit = decontaminate(docs, items).filter("n_hit > 0").groupBy(F.col("row_key").alias("key")).agg(F.count("*").alias("n"))
    return rows_in(docs, checkpoint(hit), "left_anti")
