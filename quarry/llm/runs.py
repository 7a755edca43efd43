"""Periodic runs of words by the runs theorem, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period p, of length 2p at least, that no
neighbouring word extends keeping p. Each run has a Lyndon root that is the longest
Lyndon word at its start under an order of the words or under its reverse. Those are
the words up to the next smaller value in the inverse suffix array; in the reversed
order, in the array turned round within its document. A root is extended to both sides
by longest common extensions: range minima, by sparse tables, over the LCP arrays of
the words and of the words backwards. Every step is done for many documents at once:
documents follow each other in one array, whose order is by document first, so nothing
reaches from one into another.

Defined results: a null, empty or blank text has no words, no runs and an empty
collapsed text; a null doc_id stays null; repeated rows come back as often as they
occur; other columns are ignored; an empty table gives an empty result. Texts of any
length are taken whole: documents are put together up to HELD bytes, a longer one is
worked on alone, in memory linear in its words times the logarithm of their number.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame

#: Words that a run has at least, besides twice its period.
LEAST = 12

#: Bytes of text whose documents are put together in one array.
HELD = 2 << 20

#: Rounds of pointer jumping after which the rest is done one by one.
JUMPS = 40

#: Gives (a, p) where a document's words from number a on are to repeat with period p, else None.
Rewrite = Callable[[object, int], "tuple[int, int] | None"]


def suffix_ranks(key, ends):
    """(ranks, order, names) of the suffixes of ``key``, each within its document; ``ends`` has a document's end for each place.

    ``key`` tells documents apart. ``names[k]`` has equal values for places whose next
    2^k words are equal. Prefix doubling, in which only suffixes that aren't told apart
    yet are sorted again.
    """
    import numpy as np

    n = len(key)
    order = np.argsort(key, kind="stable")
    first = np.ones(n, bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    names, h = [rank.copy()], 1
    while True:
        open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(open_):
            return rank, order, names
        own = order[open_]
        ahead = own + h
        inside = ahead < ends[own]
        then = np.where(inside, rank[np.where(inside, ahead, 0)], -1)
        both = rank[own] * (n + 1) + then + 1
        by = np.argsort(both, kind="stable")
        own, both = own[by], both[by]
        order[open_] = own
        first[open_[1:]] |= both[1:] != both[:-1]
        rank[own] = np.maximum.accumulate(np.where(first[open_], open_, 0))
        names.append(rank.copy())
        h *= 2


class Extensions:
    """Longest common extensions to the right of two places of one document: LCP array and sparse table of its minima."""

    def __init__(self, key, ends, longest: int):
        import numpy as np

        self.rank, order, names = suffix_ranks(key, ends)
        n = len(key)
        a, b = order[:-1].copy(), order[1:].copy()
        lcp = np.zeros(max(n - 1, 0), np.int32)
        for k in reversed(range(len(names))):
            name = np.append(names[k], -1)
            same = name[a] == name[b]
            step = same.astype(np.int64) << k
            lcp += step.astype(np.int32)
            a += step
            b += step
        self.table = [lcp]
        while 2 << (len(self.table) - 1) <= min(longest, len(lcp)):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i, j):
        """The number of equal words from places ``i`` and ``j`` on, two arrays of different places."""
        import numpy as np

        a, b = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][a[at]], self.table[k][b[at] - (1 << k)])
        return out


def next_smaller(values):
    """For each place the next one with a smaller value; the number of values if there is none."""
    import numpy as np

    n = len(values)
    v, nxt = np.append(values, -1), np.arange(1, n + 2)
    nxt[n] = n
    left = np.arange(n)
    for _ in range(JUMPS):
        left = left[v[nxt[left]] > v[left]]
        if not len(left):
            return nxt[:n]
        nxt[left] = nxt[nxt[left]]
    v, out = v.tolist(), nxt.tolist()
    for i in reversed(left.tolist()):
        j, own = out[i], v[i]
        while v[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out[:n])


def find_runs(codes, sizes, least: int = LEAST):
    """(start, length, period) arrays of all runs, by start and then period; starts count from the first word of all.

    ``codes`` are the words of all documents as numbers from 0 on, ``sizes`` the documents' numbers of words.
    """
    import numpy as np

    codes, sizes = np.asarray(codes, np.int64), np.asarray(sizes, np.int64)
    sizes = sizes[sizes > 0]
    n = len(codes)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    last = np.cumsum(sizes)
    begins, ends = np.repeat(last - sizes, sizes), np.repeat(last, sizes)
    # Later documents have smaller keys, so each document's end is a smaller value to all of its places.
    key = (len(sizes) - 1 - np.repeat(np.arange(len(sizes)), sizes)) * (int(codes.max()) + 1) + codes
    longest = int(sizes.max())
    right = Extensions(key, ends, longest)
    left = Extensions(key[::-1].copy(), (n - begins)[::-1].copy(), longest)

    place = np.arange(n)
    turned = 2 * (n - ends) + (ends - begins) - 1 - right.rank  # ranks of a document begin at n - its end
    i, p = [], []
    for values, whole in ((right.rank, True), (turned, False)):
        stop = next_smaller(values)
        # In the reversed order the end of a text is greater than all, so a word that reaches it isn't a root.
        own = np.flatnonzero((stop <= ends) if whole else (stop < ends))
        i.append(place[own])
        p.append(stop[own] - own)
    i, p = np.concatenate(i), np.concatenate(p)
    wide = np.append(key, -1)
    goes_on = (i + p < ends[i]) & (wide[np.minimum(i + p, n)] == wide[i])
    came = (i > begins[i]) & (wide[i - 1] == wide[i + p - 1])
    own = goes_on | came
    i, p, goes_on, came = i[own], p[own], goes_on[own], came[own]
    after, before = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    after[goes_on] = right(i[goes_on], (i + p)[goes_on])
    before[came] = left(n - i[came], n - (i + p)[came])
    start, length = i - before, p + before + after
    own = length >= np.maximum(least, 2 * p)
    start, length, p = start[own], length[own], p[own]
    _, at = np.unique(start * (n + 1) + p, return_index=True)
    return start[at], length[at], p[at]


def _pieces(batch):
    """Parts of an Arrow batch with about HELD bytes of text each; a longer text is a part of its own."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + HELD, "right")))
        yield batch.slice(at, to - at)
        at = to


def periodic_runs(docs: DataFrame, least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs`` (doc_id, text); a narrow pass.

    ``runs`` is an array of (start, length, period) by start and then period, of runs of
    ``least`` words at least. ``collapsed`` has the words joined by one space, less those
    that any run contains after its first period. ``rewrite`` may make a document's last
    words repeat before runs are looked for.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in _pieces(batch):
                docs = []
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.large_binary())):
                    words = (raw.as_py() or b"").split()
                    if rewrite and words and (own := rewrite(doc_id, len(words))):
                        a, p = own
                        words[a:] = itertools.islice(itertools.cycle(words[a : a + p]), len(words) - a)
                    docs.append(words)
                sizes = np.fromiter(map(len, docs), np.int64, len(docs))
                coded = pa.array(itertools.chain.from_iterable(docs), pa.large_binary(), size=int(sizes.sum())).dictionary_encode()
                start, length, period = find_runs(coded.indices.to_numpy(), sizes, least)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                change = np.zeros(edges[-1] + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                stays = np.cumsum(change)[:-1] == 0
                cuts = np.searchsorted(start, edges)
                texts = [
                    b" ".join(words if cuts[d] == cuts[d + 1] else itertools.compress(words, stays[edges[d] : edges[d + 1]].tolist()))
                    for d, words in enumerate(docs)
                ]
                local = start - np.repeat(edges[:-1], np.diff(cuts))
                found = pa.StructArray.from_arrays([pa.array(local), pa.array(length), pa.array(period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), found), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    schema = f"doc_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
