"""Exact and greedy near-duplicate removal inside groups, and embeddings to compare by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.fixed import SIMILARITY
from quarry.operators.cells import choose, deal, dimension, matrix_of, vector_rows
from quarry.scale import checkpoint


def exact_first(df: DataFrame, keys: list[str], order: list[str], group: str | None = None) -> DataFrame:
    """The first row by ``order`` of each key, inside its group.

    Rows of a key are combined before they are shuffled, so a key that many rows
    share doesn't gather in one task.
    """
    by = [F.col(f"`{c}`") for c in ([group] if group else []) + keys]
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    names = [f"_k{i}" for i in range(len(by))]
    best = df.select(*(c.alias(n) for c, n in zip(by, names)), F.struct(*(F.col(f"`{c}`") for c in order)).alias("_order"), whole)
    return best.groupBy(*names).agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


#: Rows of a group that one task scans; a larger group is dealt out by cells, each scanned for so many rows at once.
GROUP_ROWS = 20_000

#: Rows that a cell of a large group has on average, where as many cells are worth it.
CELL_ROWS = 64

#: Rows that are compared at once.
BLOCK = 256

GONE, KEPT, OPEN = 0, 1, 2


def scan_in_order(vectors, own, threshold: float):
    """(labels, comparisons) of rows in order, of which only those of ``own`` can be kept for certain.

    A row is GONE if it is near an earlier KEPT one. It is OPEN if it is near an earlier
    OPEN one, or isn't one's own: then something that isn't here may decide. Else it is KEPT.
    """
    import numpy as np

    n, made = len(vectors), 0
    labels = np.zeros(n, np.int8)
    held = {KEPT: np.empty_like(vectors), OPEN: np.empty_like(vectors)}
    size = {KEPT: 0, OPEN: 0}
    for a in range(0, n, BLOCK):
        part = vectors[a : a + BLOCK]
        near = {k: (part @ held[k][: size[k]].T > threshold).any(axis=1) for k in held}
        inside = part @ part.T > threshold
        made += len(part) * (size[KEPT] + size[OPEN]) + len(part) * (len(part) - 1) // 2
        found = np.zeros(len(part), np.int8)
        for i in range(len(part)):
            before = found[:i][inside[i, :i]]
            if near[KEPT][i] or (before == KEPT).any():
                continue
            found[i] = KEPT if own[a + i] and not near[OPEN][i] and not (before == OPEN).any() else OPEN
        for k in held:
            rows = part[found == k]
            held[k][size[k] : size[k] + len(rows)] = rows
            size[k] += len(rows)
        labels[a : a + len(part)] = found
    return labels, made


def _scanner(order, embedding: str, threshold: float):
    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        has = pdf[embedding].notna().to_numpy()
        stays = np.ones(len(pdf), bool)
        if has.any():
            vectors = np.stack([*pdf[embedding][has]]).astype(np.float64)
            stays[has] = scan_in_order(vectors, np.ones(len(vectors), bool), threshold)[0] == KEPT
        return pdf[stays]

    return scan


def greedy_keep(df: DataFrame, group: str, order: str | list[str], embedding: str, threshold: float = SIMILARITY, comparisons: Accumulator | None = None, group_rows: int | None = None) -> DataFrame:
    """Rows that survive a scan of their group in order: a kept row removes later rows of similarity above ``threshold``.

    Removed rows remove nothing; a row without a vector stays and removes nothing. A
    group of at most ``group_rows`` (GROUP_ROWS) is scanned by one task, larger ones are
    dealt out by cells (:func:`_keep_in_cells`): the same rows as by one scan, and no task
    holds a group. ``comparisons`` adds up the pairs of vectors that cells compare.
    """
    orders = [order] if isinstance(order, str) else list(order)
    group_rows = group_rows or GROUP_ROWS
    scan = _scanner(orders, embedding, threshold)
    own = F.col(f"`{group}`")
    large = df.groupBy(own.alias("_g")).agg(F.count("*").alias("_n")).filter(F.col("_n") > group_rows).select("_g", F.monotonically_increasing_id().alias("_gid"))
    large = checkpoint(large)
    if large.isEmpty():
        return df.groupBy(group).applyInPandas(scan, df.schema)
    large = F.broadcast(large)  # a row for each GROUP_ROWS rows at most
    same = own.eqNullSafe(F.col("_g"))
    small = df.join(large, same, "left_anti").groupBy(group).applyInPandas(scan, df.schema)
    rest = checkpoint(df.join(large, same).drop("_g").withColumn("_rid", F.monotonically_increasing_id()))
    # Rows that are equal throughout may change places.
    at = F.struct(*(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(orders)), F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields)).alias("h"), F.col("_rid").alias("rid"))
    slim = rest.select(F.col("_gid").alias("g"), at.alias("at"), F.col("_rid").alias("rid"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    kept = _keep_in_cells(slim, threshold, group_rows, comparisons).select(F.col("rid").alias("_rid"))
    return small.unionByName(rest.join(kept, "_rid", "left_semi").select(*(F.col(f"`{c}`") for c in df.columns)))


def _reaching(rows: DataFrame) -> DataFrame:
    """``rows`` once for each cell that they are in or reach, with ``own`` for the cell that they are in."""
    others = [c for c in rows.columns if c not in ("cell", "reach")]
    return rows.select(*others, F.col("cell").alias("_home"), F.explode(F.concat(F.array("cell"), "reach")).alias("cell")).withColumn("own", F.col("cell") == F.col("_home")).drop("_home")


def _keep_in_cells(rows: DataFrame, threshold: float, group_rows: int, comparisons: Accumulator | None = None) -> DataFrame:
    """(rid) of the rows (g, at, rid, v) that a scan of each g in the order of ``at`` keeps.

    First the heads of the groups are scanned, and what is near a row kept goes: kept rows
    are copied to the cells of pivots that they reach, and all others of a cell, in parts,
    meet these only. That is done again for as long as it removes half of the rows.

    Then all cells are scanned at once. Rows are in the cells of their nearest pivots,
    and in each other cell that they reach, where they may decide but aren't decided. A
    cell scans the first of its rows: one is kept for certain if no earlier row in reach is
    open. What is near a row kept goes, all others stay open for the next round. The
    earliest open row of a group is always decided. These rounds follow chains of near
    rows from cell to cell, not the number of rows. Where the bounds leave out nothing,
    a group is one cell, and takes a round for each GROUP_ROWS rows that stay: a round
    scans and parts twice as many rows as the one before, from ``group_rows`` up to GROUP_ROWS.
    """
    add = comparisons.add if comparisons is not None else lambda n: None
    rows = checkpoint(rows.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)))
    greatest = checkpoint(rows.groupBy("g").agg(F.coalesce(F.max("n2"), F.lit(0.0)).alias("longest")))  # a row a large group
    longest = {g: x**0.5 for g, x in greatest.collect()}
    rows = rows.join(F.broadcast(greatest), "g")
    # A vector too short to be near any, or none at all, is kept and removes nothing.
    alone = F.col("v").isNull() | (F.size("v") == 0) | (F.sqrt(F.col("n2") * F.col("longest")) * (1 + 1e-9) <= threshold)
    kept = rows.filter(alone).select("rid")
    # Of equal vectors that are near themselves only the first can be kept, so the others go at once.
    near_itself = F.col("n2") * (1 - 1e-9) > threshold
    single = rows.filter(~alone & ~near_itself).select("g", "at", "rid", "v")
    first = rows.filter(~alone & near_itself).groupBy("g", "v").agg(F.min("at").alias("at")).select("g", "at", F.col("at.rid").alias("rid"), "v")
    rows = checkpoint(single.unionByName(first))
    dim = dimension(rows, "v")
    if not dim:
        return kept
    most, limit = vector_rows(dim, group_rows), vector_rows(dim, max(group_rows, GROUP_ROWS))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("rn").reset_index(drop=True)
        labels, made = scan_in_order(np.stack([*pdf["v"]]), pdf["own"].to_numpy(), threshold)
        add(made)
        return pdf[labels == KEPT][["rid", "v", "cell", "reach"]]

    def beyond(part: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        part = part[~part["rid"].isin(new["rid"])].drop(columns="part")
        if part.empty or new.empty:
            return part
        vectors, held = np.stack([*part["v"]]), np.stack([*new["v"]])
        add(len(vectors) * len(held))
        near = [(vectors[i : i + 1000] @ held.T > threshold).any(axis=1) for i in range(0, len(vectors), 1000)]
        return part[~np.concatenate(near)]

    def scanned(heads: DataFrame, by: str) -> DataFrame:
        """The rows kept for certain of the first ``most`` of each ``by`` in order."""
        place = F.row_number().over(Window.partitionBy(by).orderBy("at"))
        heads = heads.withColumn("rn", place).filter(F.col("rn") <= most).drop("at")
        return checkpoint(heads.groupBy(by).applyInPandas(scan, "rid long, v array<double>, cell long, reach array<bigint>"))

    def without(rows: DataFrame, new: DataFrame) -> DataFrame:
        """``rows`` less those kept and those near them; a part of a cell has about ``most`` rows, and there is a row a cell of their numbers."""
        parts = F.broadcast(checkpoint(rows.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts"))))
        dealt = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts"))).drop("parts")
        spread = _reaching(new).join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "rid", "v")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name != "part")
        return checkpoint(dealt.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInPandas(beyond, schema))

    rows = deal(rows, choose(rows, CELL_ROWS, dim, threshold, longest, most), threshold, longest, comparisons)
    left = rows.count()
    while left:
        new = scanned(rows.withColumn("own", F.lit(True)), "g")
        kept, rows, before = kept.unionByName(new.select("rid")), without(rows, new), left
        left, most = rows.count(), min(2 * most, limit)
        if left > before / 2:
            break
    if not left:
        return kept
    rows = rows.drop("cell", "reach")
    rows = deal(rows, choose(rows, CELL_ROWS, dim, threshold, longest), threshold, longest, comparisons)
    while not rows.isEmpty():
        new = scanned(_reaching(rows.withColumn("r", F.col("reach"))).withColumnRenamed("r", "reach"), "cell")
        kept, rows = kept.unionByName(new.select("rid")), without(rows, new)
        most = min(2 * most, limit)
    return kept


def greedy_keep_native(df: DataFrame, group: str, order: str, embedding: str, threshold: float = SIMILARITY) -> DataFrame:
    """(group, order) of the rows that :func:`greedy_keep` keeps, as a fold of built-in functions; for small groups."""
    item = F.struct(F.col(order).alias("seq"), F.col(embedding).cast("array<double>").alias("v"))
    kind = f"array<struct<seq:{df.schema[order].dataType.simpleString()},v:array<double>>>"
    step = lambda acc, x: F.when(F.exists(acc, lambda y: dot(y["v"], x["v"]) > threshold), acc).otherwise(F.array_append(acc, x))
    folded = df.groupBy(group).agg(F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(kind), step).alias("kept"))
    return folded.select(group, F.explode("kept.seq").alias(order))


#: Gives unit vectors of some texts.
Embedder = Callable[[list[str]], list[list[float]]]


class HashedEmbedder:
    """A deterministic stand-in for a neural encoder: hashed character trigrams of a term, pooled to a unit vector.

    ``pooling`` "mean" counts every trigram, "first" weighs the term's first word double.
    """

    def __init__(self, size: int = 64, pooling: str = "mean"):
        self.size, self.pooling = size, pooling

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            text = text.replace("_", " ")
            for part in [text, *text.split()[:1]] if self.pooling == "first" else [text]:
                codes = [ord(c) for c in f" {part} "] + [0]
                for a, b, c in zip(codes, codes[1:], codes[2:]):
                    h = a * 961 + b * 31 + c
                    row[h % self.size] += 1 if h // self.size % 2 else -1
            row /= np.linalg.norm(row) or 1.0
        return out.tolist()


#: Gives, for each of some texts, the vectors of its tokens and which of them count.
TokenEncoder = Callable[[list[str]], list[tuple[list[list[float]], list[int]]]]


class WordEncoder:
    """A deterministic stand-in for a neural token encoder: the hashed trigrams of each word."""

    def __init__(self, size: int = 64):
        self.words = HashedEmbedder(size)

    def __call__(self, texts: list[str]) -> list[tuple[list[list[float]], list[int]]]:
        return [(self.words(w), [1] * len(w)) for w in (t.replace("_", " ").split() for t in texts)]


def encode_tokens(df: DataFrame, make_encoder: Callable[[], TokenEncoder], text: str) -> DataFrame:
    """``df`` with ``vectors`` (a vector a token) and ``mask`` of ``text``; the encoder is made once a worker task."""
    own = [f for f in df.schema.fields if f.name not in ("vectors", "mask")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", vectors array<array<double>>, mask array<int>"

    def run(batches: Iterator):
        import pyarrow as pa

        encoder = make_encoder()
        for batch in batches:
            found = encoder([x or "" for x in batch.column(text).to_pylist()])
            added = [pa.array([v for v, _ in found], pa.list_(pa.list_(pa.float64()))), pa.array([m for _, m in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), *added], [*(f.name for f in own), "vectors", "mask"])

    return df.mapInArrow(run, schema)


def pool_tokens(vectors, mask, pooling: str = "mean"):
    """Unit vectors of Arrow columns of token vectors and masks: the mean of the tokens that count, or the first of them; null where none does."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = matrix_of(vectors.flatten())
    seen = mask.flatten().to_numpy(zero_copy_only=False).astype(bool)
    if len(seen) != len(flat):
        raise ValueError("vectors and masks have different numbers of tokens")
    row = np.repeat(np.arange(len(sizes)), sizes)[seen]
    own, first, counts = np.unique(row, return_index=True, return_counts=True)
    if not len(own):
        return pa.nulls(len(sizes), pa.list_(pa.float64()))
    tokens = flat[seen]
    out = tokens[first] if pooling == "first" else np.add.reduceat(tokens, first, axis=0) / counts[:, None]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    cuts = np.zeros(len(sizes) + 1, np.int32)
    cuts[own + 1] = out.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(cuts, dtype=np.int32)), pa.array(out.ravel()))
    return pc.if_else(pa.array(np.isin(np.arange(len(sizes)), own)), lists, pa.scalar(None, pa.list_(pa.float64())))


def pooled(df: DataFrame, into: str = "embedding", pooling: str = "mean") -> DataFrame:
    """``df`` (vectors, mask, ...) with a unit vector a row instead of its tokens': their "mean" or the "first"; a narrow pass."""
    if pooling not in ("mean", "first"):
        raise ValueError(f"no pooling {pooling!r}")
    own = [f for f in df.schema.fields if f.name not in ("vectors", "mask", into)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + f", `{into}` array<double>"

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), pool_tokens(batch.column("vectors"), batch.column("mask"), pooling)], [*(f.name for f in own), into])

    return df.mapInArrow(run, schema)


def embed(df: DataFrame, make_embedder: Callable[[], Embedder], text: str, into: str = "embedding") -> DataFrame:
    """``df`` with the vectors of ``text``; the embedder is made once a worker task."""
    own = [f for f in df.schema.fields if f.name != into]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + f", `{into}` array<double>"

    def run(batches: Iterator):
        import pyarrow as pa

        embedder = make_embedder()
        for batch in batches:
            vectors = embedder([x or "" for x in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), pa.array(vectors, pa.list_(pa.float64()))], [*(f.name for f in own), into])

    return df.mapInArrow(run, schema)


def dedup_concepts(concepts: DataFrame, group: str, order: str | list[str], threshold: float = SIMILARITY, make_embedder: Callable[[], Embedder] = HashedEmbedder) -> DataFrame:
    """Exact duplicates by (concept, category) and then near-duplicates by embedding, inside each group."""
    unique = exact_first(concepts, ["concept", "category"], [order] if isinstance(order, str) else order, group)
    vectors = checkpoint(embed(unique, make_embedder, "concept", "_v"))  # read twice: groups are counted first
    return greedy_keep(vectors, group, order, "_v", threshold).drop("_v")


def numbered(df: DataFrame, group: str, order: list[str], into: str = "seq") -> DataFrame:
    """``df`` with the place of each row in its group."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
