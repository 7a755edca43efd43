"""Terminology alignment: lexical lookup, nearest concept, greedy descent of a hierarchy, and summaries.

A terminology is a table (code, display, parent_code, pos, embedding); roots have
no parent. Ties go to the smaller ``pos``. A null or empty vector has no nearest
concept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.fixed import CHILD_LIMIT, DESCENT_THRESHOLD
from quarry.functions.junk import normalize
from quarry.operators.cells import Pivots, dimension, matrix_of, sample, vector_rows
from quarry.operators.dedup import dot
from quarry.scale import BROADCAST_ROWS, checkpoint, count_bounded, gathered, look_up

#: Candidates up to which they are sent to the workers whole.
CANDIDATES = 20_000

#: Concepts up to which a hierarchy is sent to the workers whole.
HIERARCHY_ROWS = 50_000


def query_text(concept: Column) -> Column:
    return F.replace(concept, F.lit("_"), F.lit(" "))


def lexical_match(concepts: DataFrame, terms: DataFrame, concept: str = "concept", term: str = "term") -> DataFrame:
    """``concepts`` with ``found``: 1 if the concept's normal form is that of a term, else 0."""
    own = terms.select(normalize(F.col(term)).alias("_term")).filter("_term <> ''").distinct()
    keyed = concepts.withColumn("_term", normalize(query_text(F.col(concept))))
    joined = look_up(keyed, own.withColumn("_hit", F.lit(1)), "_term")  # no frequent concept's rows meet in a task
    return joined.withColumn("found", F.coalesce("_hit", F.lit(0))).drop("_term", "_hit")


def children(terminology: DataFrame, limit: int = CHILD_LIMIT) -> DataFrame:
    """(parent_code, code, display, pos, embedding): the first ``limit`` children of each concept by place."""
    place = F.row_number().over(Window.partitionBy("parent_code").orderBy("pos", "code"))
    own = terminology.filter(F.col("parent_code").isNotNull()).withColumn("_place", place)
    return own.filter(F.col("_place") <= limit).select("parent_code", "code", "display", "pos", "embedding")


def descendants(terminology: DataFrame, limit: int | None = CHILD_LIMIT) -> DataFrame:
    """(ancestor, code, pos, depth) for all that lie below each concept, nearest first, at most ``limit`` each.

    Levels are joined one by one, at whatever depth, and their lineage is cut. With a
    limit k an ancestor goes down with the at most k concepts of its last level, each
    of which brings its first k children, and is done once it has k: a level has at
    most k rows an ancestor, however deep the hierarchy. A concept that is met below itself is an error.
    """
    edges = checkpoint(terminology.filter(F.col("parent_code").isNotNull()).select("parent_code", "code", "pos"))
    return _every_level(edges) if limit is None else _nearest_levels(edges, limit)


def _every_level(edges: DataFrame) -> DataFrame:
    down = F.broadcast(edges) if count_bounded(edges, BROADCAST_ROWS) else edges
    level = every = edges.select(F.col("parent_code").alias("ancestor"), "code", "pos", F.lit(1).alias("depth"))
    depth = 1
    while _filled(level):
        depth += 1
        level = checkpoint(level.select("ancestor", F.col("code").alias("parent_code")).join(down, "parent_code").select("ancestor", "code", "pos", F.lit(depth).alias("depth")))
        every = every.union(level)
    return every


def _filled(level: DataFrame) -> bool:
    """Whether a level has rows; an error if a concept is below itself."""
    n, cycles = level.agg(F.count("*"), F.count_if(F.col("ancestor") == F.col("code"))).first()
    if cycles:
        raise ValueError("a concept is below itself")
    return n > 0


def _nearest_levels(edges: DataFrame, limit: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("parent_code").orderBy("pos", "code"))
    first = edges.withColumn("_place", place).filter(F.col("_place") <= limit)
    kids = checkpoint(first.groupBy(F.col("parent_code").alias("code")).agg(F.collect_list(F.struct("pos", F.col("code").alias("child"))).alias("kids")))
    front = kids.select(F.col("code").alias("ancestor"), "code", F.lit(limit).alias("left"))
    every, depth = None, 0
    while True:
        depth += 1
        met = look_up(front, kids, "code", max(1, BROADCAST_ROWS // limit)).filter("kids IS NOT NULL")
        own = met.groupBy("ancestor").agg(F.min("left").alias("left"), F.array_sort(F.flatten(F.collect_list("kids"))).alias("found"))
        own = own.select("ancestor", F.explode(F.slice("found", F.lit(1), F.col("left"))).alias("x"), (F.col("left") - F.size("found")).alias("left"))
        level = checkpoint(own.select("ancestor", F.col("x.child").alias("code"), F.col("x.pos").alias("pos"), F.lit(depth).alias("depth"), "left"))
        rows = level.drop("left")
        every = rows if every is None else every.union(rows)
        if not _filled(rows):
            return every
        front = level.filter("left > 0").select("ancestor", "code", "left")


def _exact(a, b) -> float:
    """The dot product as a plain sum in order, which is equal for equal vectors."""
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        total += x * y
    return total


def best_of(queries, codes, places, vectors, block: int = 2048):
    """(code, score, -place) of the greatest dot product for each row of ``queries``; ties to the smaller place, then the greater code.

    Products come from one matrix product a block; what is within rounding of the
    greatest is worked out anew in order, so equal vectors tie.
    """
    import numpy as np

    out = []
    for a in range(0, len(queries), block):
        part = queries[a : a + block]
        scores = part @ vectors.T
        top = scores.max(axis=1)
        for q, row, t in zip(part, scores, top):
            found = max((_exact(q, vectors[j]), -places[j], codes[j]) for j in np.flatnonzero(row >= t - 1e-9))
            out.append((found[2], found[0], found[1]))
    return out


def _plain(df: DataFrame, embedding: str) -> DataFrame:
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))


def _scan(df: DataFrame, embedding: str, columns: str, answer) -> DataFrame:
    """``df`` with ``columns`` from ``answer`` (matrix of vectors to rows of values, in order), in one narrow pass."""
    import pyarrow as pa

    schema = f"row struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in df.schema.fields)}>, found struct<{columns}>"

    def run(batches: Iterator):
        import numpy as np

        for batch in batches:
            vectors = batch.column("v").to_pylist()
            own = [i for i, v in enumerate(vectors) if v and None not in v]
            found: list = [None] * len(vectors)
            if own:
                for i, x in zip(own, answer(np.array([vectors[i] for i in own], np.float64))):
                    found[i] = x
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, kind)], ["row", "found"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(f"struct<{columns}>"))
    out = _plain(df, embedding).mapInArrow(run, schema)
    names = [x.split(":")[0] for x in columns.split(",")]
    return out.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c not in names), *(F.col("found").getField(c).alias(c) for c in names))


def nearest(df: DataFrame, candidates: DataFrame, embedding: str = "embedding", comparisons: Accumulator | None = None) -> DataFrame:
    """``df`` with ``code`` and ``score`` of the candidate (code, pos, embedding) of the greatest dot product.

    Up to CANDIDATES of them are a matrix that is sent to the workers, with which
    batches of rows are multiplied; more are searched by balls (:func:`nearest_in_balls`).
    ``comparisons`` adds up the pairs of a row and a candidate that balls compare.
    """
    import numpy as np

    spark = df.sparkSession
    kind = candidates.schema["code"].dataType.simpleString()
    own = _candidates(candidates)
    dim = dimension(own, "v")
    if not dim:
        return df.withColumns({"code": F.lit(None).cast(kind), "score": F.lit(None).cast("double")})
    if not count_bounded(own, vector_rows(dim, CANDIDATES)):
        return nearest_in_balls(df, candidates, embedding, comparisons)
    block = own.collect()  # at most CANDIDATES, of bounded size
    sent = spark.sparkContext.broadcast(([r.code for r in block], [r.pos for r in block], np.array([r.v for r in block], np.float64)))

    def answer(vectors):
        return [{"code": c, "score": s} for c, s, _ in best_of(vectors, *sent.value)]

    return _scan(df, embedding, f"code:{kind},score:double", answer)


def _candidates(candidates: DataFrame) -> DataFrame:
    return candidates.select("code", "pos", F.col("embedding").cast("array<double>").alias("v")).filter(_whole("v"))


def _whole(vector: str) -> Column:
    """Whether a vector can be compared: neither null nor empty, and without nulls."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull())


#: Candidates that a ball has on average, and rows that a task compares with a ball.
BALL_ROWS, ASKED_ROWS = 500, 20_000

#: Candidates of a ball up to which it isn't parted further.
LEAF_ROWS = 256

#: Balls that a row is sent to at most, and the part of all balls. One that may find a better candidate in more of them is compared with all candidates, tile by tile.
ASKED_BALLS, ASKED_PART = 32, 1 / 4

#: Rows and candidates of a tile.
TILE_ROWS = 50_000


def upper_bounds(queries, centres, radii, norms):
    """Upper bounds on the dot product of each query with what is in each ball: a vector is its centre and at most a radius."""
    import numpy as np

    length = np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]
    return np.minimum(queries @ centres.T + length * radii, length * norms) + 1e-9 * (1 + length * norms)


def products(a, b):
    """The dot products of the rows of two matrices, as plain sums in order like :func:`_exact`."""
    import numpy as np

    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        total += x * y
    return total


def best_in_tile(queries, least, codes, places, vectors, block: int = 2048):
    """(rows, scores, numbers of candidates, comparisons): the best candidate of each row that has one of a score of at least ``least``.

    Many candidates are parted into leaves around some of them. A query goes to the one with the
    greatest bound first, and then to those whose bounds reach what it has found. A leaf's
    products are in single precision; what is within their rounding of the greatest is worked out anew in order.
    """
    import numpy as np

    (n, dim), made = vectors.shape, 0
    step = max(1, min(int(n**0.5), LEAF_ROWS // 6)) if n > LEAF_ROWS else n
    centres = vectors[::step]
    square = np.einsum("ij,ij->i", centres, centres)
    home, far = np.zeros(n, np.int64), np.zeros(n)
    for a in range(0, n, block):
        part = vectors[a : a + block]
        apart = np.einsum("ij,ij->i", part, part)[:, None] + square - 2 * (part @ centres.T)
        home[a : a + block] = apart.argmin(axis=1)
        far[a : a + block] = np.sqrt(np.maximum(apart.min(axis=1), 0.0)) + 1e-7
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(len(centres) + 1)).tolist()
    leaves = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
    vectors, far = vectors[order], far[order]
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    radii, norms = (np.array([x[leaf].max(initial=0.0) for leaf in leaves]) for x in (far, length))
    ranks = np.empty(n, np.int64)
    ranks[sorted(range(n), key=lambda j: (-places[j], codes[j]))] = np.arange(n)
    ranks = ranks[order]
    longest = length.max(initial=0.0) or 1.0
    small = (vectors / longest).astype(np.float32)
    slack = (dim + 8) * 2.0**-22  # over twice the rounding of a sum of products of vectors of norm one
    best, top, code = np.array(least, np.float64), np.full(len(queries), -1), np.full(len(queries), -1)
    for at in range(0, len(queries), block):
        q = queries[at : at + block]
        norm = np.sqrt(np.einsum("ij,ij->i", q, q))
        norm[norm == 0] = 1.0
        own, unit, now = (q / norm[:, None]).astype(np.float32), norm * longest, best[at : at + block]
        bounds = upper_bounds(q, centres, radii, norms)
        bounds[:, [a == b for a, b in zip(cuts, cuts[1:])]] = -np.inf
        first = bounds.argmax(axis=1)

        def ask(rows, leaf):
            nonlocal made
            scores = (own if len(rows) == len(own) else own[rows]) @ small[leaves[leaf]].T
            made += scores.size
            found = scores.max(axis=1)
            bound = np.maximum(found, now[rows] / unit[rows]) - slack
            may = np.flatnonzero(found >= bound)
            if not len(may):
                return
            i, j = np.nonzero(scores[may] >= bound[may, None].astype(np.float32))
            i, j = rows[may[i]], j + cuts[leaf]
            exact = products(q[i], vectors[j])
            last = np.lexsort((ranks[j], exact, i))
            last = last[np.append(np.diff(i[last]) > 0, True)]  # the best pair of each row
            i, j, exact = i[last], j[last], exact[last]
            better = (exact > now[i]) | ((exact == now[i]) & (ranks[j] > top[at + i]))
            i, j = i[better], j[better]
            now[i], top[at + i], code[at + i] = exact[better], ranks[j], order[j]

        for leaf in np.unique(first).tolist():
            ask(np.flatnonzero((first == leaf) & (bounds[:, leaf] >= now)), leaf)
        for leaf in range(len(leaves)):
            rows = np.flatnonzero((first != leaf) & (bounds[:, leaf] >= now))
            if len(rows):
                ask(rows, leaf)
    rows = np.flatnonzero(code >= 0)
    return rows, best[rows], code[rows], made


def best_in_ball(queries, least, codes, places, vectors):
    """([(score, -place, code) or None of each query], comparisons): the best candidate where one reaches ``least``."""
    found: list = [None] * len(queries)
    rows, scores, best, made = best_in_tile(queries, least, codes, places, vectors)
    for i, score, j in zip(rows.tolist(), scores.tolist(), best.tolist()):
        found[i] = (score, -places[j], codes[j])
    return found, made


def nearest_in_balls(df: DataFrame, candidates: DataFrame, embedding: str = "embedding", comparisons: Accumulator | None = None) -> DataFrame:
    """:func:`nearest` of any number of candidates, one at least, exact.

    Candidates are dealt to balls around a sample of them. Each row asks the ball of the
    nearest centre, and then every ball whose bound reaches the score found there. A
    ball that is too large for a task is several, and the rows that ask it are dealt
    out as well. Only the centres, and three numbers for each, come to the driver.

    Rows for which the bounds leave over ASKED_BALLS balls, as where nothing is near
    anything, are compared with all candidates: both are dealt to tiles, of which each
    pair is a task's matrix products. So a row is copied for ASKED_BALLS balls or for each
    tile of candidates at most, not for each ball.
    """
    import numpy as np

    spark = df.sparkSession
    kind = candidates.schema["code"].dataType.simpleString()
    own = _candidates(candidates)
    dim = dimension(own, "v")
    add = comparisons.add if comparisons is not None else lambda n: None
    # Of equal vectors one is the best for every row.
    own = checkpoint(own.groupBy("v").agg(F.max(F.struct((-F.col("pos")).alias("place"), F.col("code"))).alias("x")).select(F.lit(0).cast("long").alias("g"), "v", (-F.col("x.place")).alias("pos"), "x.code"))
    pivots = Pivots(sample(own, BALL_ROWS, dim))
    _, centres, _, _ = pivots.groups[0]
    sent = spark.sparkContext.broadcast(pivots)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            vectors = matrix_of(batch.column("v"))
            cell, far = sent.value.cells(0, vectors)
            norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("v", "pos", "code")), pa.array(cell), pa.array(far), pa.array(norm)], ["v", "pos", "code", "cell", "far", "norm"])

    balls = checkpoint(own.mapInArrow(place, f"v array<double>, pos {own.schema['pos'].dataType.simpleString()}, code {kind}, cell long, far double, norm double"))
    most = vector_rows(dim, ASKED_ROWS)
    sizes = checkpoint(balls.groupBy("cell").agg(F.max("far").alias("far"), F.max("norm").alias("norm"), F.ceil(F.count("*") / most).alias("slices")))
    radii, norms = np.full(pivots.size, 0.0), np.full(pivots.size, -np.inf)  # a cell without candidates has no bound that reaches anything
    for r in sizes.collect():
        radii[r.cell], norms[r.cell] = r.far + 1e-7, r.norm
    bounds = spark.sparkContext.broadcast((centres, radii, norms))
    slices = F.broadcast(sizes.select("cell", "slices"))
    balls = balls.join(slices, "cell").select("cell", F.pmod(F.xxhash64("code", "pos", "v"), F.col("slices")).alias("slice"), "v", "pos", "code")

    def ask(batches):
        """(rid, v, least, cell) for each ball that a row asks: the one of the nearest centre, or all others that may be better; cell -1 for all of them where they are many."""
        import numpy as np
        import pyarrow as pa

        centres, radii, norms = bounds.value
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                vectors = matrix_of(batch.column("v"))
                reach = upper_bounds(vectors, centres, radii, np.maximum(norms, 0.0))
                reach[:, np.isinf(norms)] = -np.inf
                first = np.where(np.isinf(norms), -np.inf, vectors @ centres.T).argmax(axis=1)
                if "least" in batch.schema.names:
                    least = batch.column("least").to_numpy()
                    asked = (reach >= least[:, None]) & (np.arange(len(norms)) != first[:, None])
                    many = asked.sum(axis=1) > min(ASKED_BALLS, len(norms) * ASKED_PART)
                    asked[many] = False
                    row, cell = np.nonzero(asked)
                    row, cell = np.append(row, np.flatnonzero(many)), np.append(cell, np.full(many.sum(), -1))
                else:
                    row, cell, least = np.arange(len(batch)), first, np.full(len(batch), -np.inf)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column("rid"), taken.column("v"), pa.array(least[row]), pa.array(cell)], ["rid", "v", "least", "cell"])

    def best(asked: pd.DataFrame, ball: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if asked.empty or ball.empty:
            return pd.DataFrame({"rid": [], "score": [], "place": [], "code": []})
        found, made = best_in_ball(np.stack([*asked["v"]]), asked["least"].to_numpy(), ball["code"].tolist(), ball["pos"].tolist(), np.stack([*ball["v"]]))
        add(made)
        rows = [(r, *x) for r, x in zip(asked["rid"], found) if x]
        return pd.DataFrame(rows, columns=["rid", "score", "place", "code"])

    def answers(asks: DataFrame) -> DataFrame:
        asks = checkpoint(asks)
        parts = F.broadcast(checkpoint(asks.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts"))))
        dealt = asks.join(parts, "cell").join(slices, "cell").select(
            "cell", F.pmod(F.xxhash64("rid"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "rid", "v", "least"
        )
        spread = balls.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "slice", "v", "pos", "code")
        keys = ("cell", "part", "slice")
        return checkpoint(dealt.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(best, f"rid long, score double, place long, code {kind}"))

    def tiled(asks: DataFrame) -> DataFrame:
        """The answers of all candidates to ``asks``, a task for a tile of rows and a tile of candidates."""
        tile = vector_rows(dim, TILE_ROWS)
        parts, slices = (max(1, -(-x.count() // tile)) for x in (asks, own))
        deal = lambda df, name, key, n, other, m: df.withColumn(name, F.pmod(F.xxhash64(*key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
        rows = deal(asks.select("rid", "v", "least"), "part", ["rid"], parts, "slice", slices)
        spread = deal(balls, "slice", ["cell", "slice"], slices, "part", parts).drop("cell")  # a ball's candidates are in one tile, so its leaves are small
        keys = ("part", "slice")
        return checkpoint(rows.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(best_of_all, f"rid long, score double, place long, code {kind}"))

    def best_of_all(asked, tile):
        import numpy as np
        import pyarrow as pa

        rid, found, score, place, codes = pa.array([], pa.int64()), [], [], [], tile.column("code").combine_chunks()
        if len(asked) and len(tile):
            rid, places = asked.column("rid").combine_chunks(), tile.column("pos").to_numpy()
            rows, score, found, made = best_in_tile(matrix_of(asked.column("v").combine_chunks()), asked.column("least").to_numpy(), codes.to_pylist(), places.tolist(), matrix_of(tile.column("v").combine_chunks()))
            add(made)
            rid, place = rid.take(pa.array(rows)), -places[found]
        return pa.table({"rid": rid, "score": pa.array(score, pa.float64()), "place": pa.array(place, pa.int64()), "code": codes.take(pa.array(found, pa.int64()))})

    rows = checkpoint(df.withColumn("_rid", F.monotonically_increasing_id()))
    queries = checkpoint(rows.select(F.col("_rid").alias("rid"), F.col(f"`{embedding}`").cast("array<double>").alias("v")).filter(_whole("v")))
    schema = "rid long, v array<double>, least double, cell long"
    first = answers(queries.mapInArrow(ask, schema))
    more = queries.join(first.groupBy("rid").agg(F.max("score").alias("least")), "rid").select("rid", "v", "least")
    asks = checkpoint(more.mapInArrow(ask, schema))
    second = answers(asks.filter("cell >= 0"))
    many = asks.filter("cell < 0")
    third = second.limit(0) if many.isEmpty() else tiled(many)
    found = first.union(second).union(third).groupBy(F.col("rid").alias("_rid")).agg(F.max(F.struct("score", "place", "code")).alias("_best"))
    columns = [F.col(f"`{c}`") for c in df.columns if c not in ("code", "score")]
    return rows.join(found, "_rid", "left").select(*columns, F.col("_best.code").alias("code"), F.col("_best.score").alias("score"))


def descend(df: DataFrame, terminology: DataFrame, key: str, embedding: str = "embedding", limit: int = CHILD_LIMIT, threshold: float = DESCENT_THRESHOLD) -> DataFrame:
    """(key, code, score, steps, accepted): from the nearest root down to the best child for as long as that is strictly better.

    A hierarchy of at most HIERARCHY_ROWS concepts is sent to the workers, which walk
    it to the end for their rows: one narrow pass at any depth. A larger one is
    joined level by level, a row to all children of its concept, until every row has
    stopped; each level's lineage is cut. Rows of equal keys stay apart.
    """
    below = children(terminology, limit).filter(F.col("embedding").isNotNull())
    roots = terminology.filter(F.col("parent_code").isNull())
    state = nearest(df.select(F.col(key), F.col(embedding).alias("_e")), roots, "_e").withColumn("steps", F.lit(0))
    if count_bounded(below, vector_rows(dimension(below, "embedding"), HIERARCHY_ROWS)):
        out = _walk(state, below, key)
    else:
        out = _levels(state, below, key)
    return out.withColumn("accepted", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def _walk(state: DataFrame, below: DataFrame, key: str) -> DataFrame:
    import numpy as np

    kind = state.schema["code"].dataType.simpleString()
    kids: dict = {}
    for r in below.select("parent_code", "code", "pos", F.col("embedding").cast("array<double>").alias("v")).collect():  # at most HIERARCHY_ROWS
        kids.setdefault(r.parent_code, []).append(r)
    packed = {p: ([r.code for r in x], [r.pos for r in x], np.array([r.v for r in x], np.float64)) for p, x in kids.items()}
    sent = state.sparkSession.sparkContext.broadcast(packed)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields if f.name in (key, "code", "score", "steps"))

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            codes, scores, steps = (batch.column(c).to_pylist() for c in ("code", "score", "steps"))
            vectors, open_rows = batch.column("_e").to_pylist(), {}
            for i, c in enumerate(codes):
                if c in sent.value and vectors[i]:
                    open_rows.setdefault(c, []).append(i)
            while open_rows:
                then: dict = {}
                for c, rows in open_rows.items():
                    for i, (code, score, _) in zip(rows, best_of(np.array([vectors[i] for i in rows], np.float64), *sent.value[c])):
                        if scores[i] is not None and score > scores[i]:
                            codes[i], scores[i], steps[i] = code, score, steps[i] + 1
                            if code in sent.value:
                                then.setdefault(code, []).append(i)
                open_rows = then
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(codes, batch.schema.field("code").type), pa.array(scores, pa.float64()), pa.array(steps, pa.int32())], [key, "code", "score", "steps"])

    ordered = state.select(key, F.col("code").cast(kind).alias("code"), "score", "steps", F.col("_e").cast("array<double>").alias("_e"))
    names = {f.split(" ")[0].strip("`"): f for f in fields.split(", ")}
    return ordered.mapInArrow(run, ", ".join(names[c] for c in (key, "code", "score", "steps")))


def _levels(state: DataFrame, below: DataFrame, key: str) -> DataFrame:
    kids = checkpoint(below.groupBy(F.col("parent_code").alias("code")).agg(F.collect_list(F.struct((-F.col("pos")).alias("place"), F.col("code").alias("child"), F.col("embedding").alias("v"))).alias("kids")))
    done = None
    state = checkpoint(state)
    while not state.isEmpty():
        met = look_up(state, kids, "code", HIERARCHY_ROWS // CHILD_LIMIT)
        best = F.array_max(F.transform(F.coalesce("kids", F.array().cast(kids.schema["kids"].dataType)), lambda x: F.struct(dot(F.col("_e"), x["v"]).alias("score"), x["place"].alias("place"), x["child"].alias("code"))))
        moved = checkpoint(gathered(met).select(key, "_e", "code", "score", "steps", best.alias("_best")).withColumn("_go", F.coalesce(F.col("_best.score") > F.col("score"), F.lit(False))))
        part = moved.filter("not _go").select(key, "code", "score", "steps")
        done = part if done is None else done.union(part)
        state = moved.filter("_go").select(key, "_e", F.col("_best.code").alias("code"), F.col("_best.score").alias("score"), (F.col("steps") + 1).alias("steps"))
    return done if done is not None else state.select(key, "code", "score", "steps")


def semantic_matches(verified: DataFrame, terminology: DataFrame, key: str, embedding: str = "embedding", threshold: float = DESCENT_THRESHOLD) -> DataFrame:
    """The misses of the lexical lookup (found = 0) that the descent accepts."""
    misses = verified.filter("found = 0")
    accepted = descend(misses, terminology, key, embedding, threshold=threshold).filter("accepted").select(key)
    return misses.join(accepted, key, "left_semi")


def tri_state(verified: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """``verified`` with ``semantic``: n/a where found, else 1 or 0 as the descent accepts it."""
    hit = accepted.select(key).distinct().withColumn("_hit", F.lit(True))
    return verified.join(hit, key, "left").withColumn("semantic", F.when(F.col("found") == 1, "n/a").when(F.col("_hit"), "1").otherwise("0")).drop("_hit")


def summary(labelled: DataFrame) -> DataFrame:
    """One row: all concepts, those found, and those found or accepted."""
    return labelled.agg(
        F.count("*").alias("total"), F.count_if(F.col("found") == 1).alias("found"), F.count_if((F.col("found") == 1) | (F.col("semantic") == "1")).alias("found_or_accepted")
    )


def preview(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)
