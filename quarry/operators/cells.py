"""Cells around pivots: an exact index for vectors, with bounds from the triangle inequality.

Each vector belongs to the cell of its nearest pivot. The pivots are a sample by hash
whose size in bytes is bounded, and they and a few numbers a cell are all that is sent
to the workers; vectors are dealt out by cell. What the bounds leave out can't matter,
and what they can't leave out is compared, so results don't depend on the pivots.
"""

from __future__ import annotations

from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scale import checkpoint

#: Pivots of all groups together, at most, and their bytes.
MOST_PIVOTS, PIVOT_BYTES = 4096, 32 << 20

#: What copying a row to a cell costs, in comparisons of two vectors.
MOVED = 500

#: Allowance for rounding in the bounds, for vectors of norm one.
SLACK = 1e-6


def vector_rows(dim: int, most: int, limit: int = 64 << 20) -> int:
    """How many vectors of ``dim`` numbers may be held at once: ``most`` at most, and no more than fit into ``limit`` bytes."""
    return max(1, min(most, limit // (8 * max(dim, 1))))


def dimension(rows: DataFrame, vector: str) -> int:
    """The length of a vector of ``rows``; 0 if there is none."""
    first = rows.filter(F.size(vector) > 0).select(F.size(vector).alias("n")).first()
    return first.n if first else 0


def matrix_of(column):
    """An Arrow column of equally long lists without nulls as a matrix."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Pivots:
    """The pivots of some groups; cells are numbered over all groups."""

    def __init__(self, groups: dict):
        """``groups`` has a matrix of different pivots for each group."""
        import numpy as np

        self.groups, self.size = {}, 0
        for g, matrix in sorted(groups.items()):
            square = np.einsum("ij,ij->i", matrix, matrix)
            between = np.sqrt(np.maximum(square[:, None] + square - 2 * (matrix @ matrix.T), 0.0))
            self.groups[g] = (self.size, matrix, square, between)
            self.size += len(matrix)

    def distances(self, group, vectors):
        """The distances of ``vectors`` to all pivots of their group."""
        import numpy as np

        _, matrix, square, _ = self.groups[group]
        own = np.einsum("ij,ij->i", vectors, vectors)
        return np.sqrt(np.maximum(own[:, None] + square - 2 * (vectors @ matrix.T), 0.0))

    def cells(self, group, vectors):
        """(cell, distance to its pivot) of each of ``vectors``."""
        import numpy as np

        far = self.distances(group, vectors)
        best = far.argmin(axis=1)
        return best + self.groups[group][0], far[np.arange(len(far)), best]

    def reached(self, group, vectors, threshold: float, longest: float):
        """(cells, row, cell): each row's own cell, and the others that may hold a vector whose dot product with the row's is above ``threshold``.

        With no norm above ``longest`` such a vector is within a distance that follows
        from the norms. A cell is out of it if the plane half-way to its pivot is.
        """
        import numpy as np

        at, _, _, between = self.groups[group]
        far = self.distances(group, vectors)
        home = far.argmin(axis=1)
        near = far[np.arange(len(far)), home][:, None]
        norms = np.einsum("ij,ij->i", vectors, vectors)[:, None] + longest**2
        square = norms - 2 * threshold
        between = between[home]
        plane = np.where(between > SLACK, (far**2 - near**2) / np.maximum(2 * between, SLACK), 0.0)
        inside = (plane < np.sqrt(np.maximum(square, 0.0)) + SLACK * (1 + norms)) & (square >= -SLACK * (1 + norms))
        inside[np.arange(len(far)), home] = False
        row, cell = np.nonzero(inside)
        return home + at, row, cell + at


def sample(rows: DataFrame, cell_rows: int, dim: int) -> dict:
    """A matrix of different vectors of ``rows`` (g, v) for each g, by hash: one for each ``cell_rows`` rows, or as many as may be held; one a group at least."""
    import numpy as np

    total = rows.count()
    most = vector_rows(dim, MOST_PIVOTS, PIVOT_BYTES)
    share = min(1.0, 1.0 / max(cell_rows, -(-total // most)))
    draw = F.shiftrightunsigned(F.xxhash64("v", F.lit(17)), 1)
    drawn = rows.filter(draw < int(share * (1 << 63)) if share < 1 else F.lit(True)).select("g", "v").distinct().orderBy(F.xxhash64("v")).limit(2 * most)
    least = rows.groupBy("g").agg(F.min_by("v", draw).alias("v"))
    out: dict = {}
    for g, v in drawn.union(least).collect():
        out.setdefault(g, {})[tuple(v)] = None
    return {g: np.array(list(x), np.float64) for g, x in out.items()}


def choose(rows: DataFrame, cell_rows: int, dim: int, threshold: float, longest: dict, copied: int | None = None) -> Pivots:
    """Pivots for ``rows`` (g, v), as many a group as cost least where ``copied`` rows of it (all, if None) are copied to the cells that they reach.

    More pivots cost more distances a row; fewer have larger cells, of which a greater
    share is reached. What is reached is measured on one half of a sample with pivots of
    the other half. Where the bounds leave out nothing, a group has one pivot.
    """
    sizes = dict(rows.groupBy("g").count().collect())
    groups = {}
    for g, drawn in sample(rows, max(1, cell_rows // 2), dim).items():
        half, tried = max(1, len(drawn) // 2), drawn[len(drawn) // 2 :][:500]
        own = sizes[g] if copied is None else min(copied, sizes[g])
        best, n = (1 + own / 2 + MOVED * own / sizes[g], 1), half
        while n > 1:
            _, row, _ = Pivots({g: drawn[:n]}).reached(g, tried, threshold, longest[g])
            cells = 1 + len(row) / len(tried)
            best = min(best, (n + cells / n * own / 2 + MOVED * cells * own / sizes[g], n))
            n //= 4
        groups[g] = drawn[: best[1]]
    return Pivots(groups)


def deal(rows: DataFrame, pivots: Pivots, threshold: float, longest: dict, comparisons: Accumulator | None = None) -> DataFrame:
    """``rows`` (g, v, ...) with ``cell`` and ``reach``, the other cells that a row reaches."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    names = rows.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                groups, vectors = batch.column("g").to_numpy(), matrix_of(batch.column("v"))
                home, rows, cells = np.zeros(len(groups), np.int64), [], []
                for g in np.unique(groups).tolist():
                    own = np.flatnonzero(groups == g)
                    home[own], row, cell = sent.value.reached(g, vectors[own], threshold, longest[g])
                    rows.append(own[row])
                    cells.append(cell)
                    if comparisons is not None:
                        comparisons.add(len(own) * len(sent.value.groups[g][1]))
                row, cell = np.concatenate(rows), np.concatenate(cells)
                cuts = np.searchsorted(np.sort(row), np.arange(len(groups) + 1)).astype(np.int32)
                reach = pa.ListArray.from_arrays(pa.array(cuts), pa.array(cell[np.argsort(row, kind="stable")]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), reach], [*names, "cell", "reach"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return checkpoint(rows.mapInArrow(run, f"{schema}, cell long, reach array<bigint>"))
