"""All rows against all, by pairs of blocks.

Many vectors are packed into one binary row, a block, and blocks meet in a Cartesian product: its tasks take one part of each
side and read the other side's shuffled blocks where they lie, so that rows are stored once for a side however many blocks
they meet.  A task holds one part of the right side, ``PART`` bytes, and what its function keeps for one left block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block's single-precision vectors, and of a part of the right side.
BLOCK_BYTES, PART = 2 << 20, 64 << 20
#: Tasks by core.
TASKS = 8
#: Bytes of an Arrow batch; a pair of blocks is one row.
BATCH_BYTES = 2 << 20


def size_of(rows: DataFrame, vector: str) -> tuple[int, int]:
    """Rows, and bytes of one in single precision."""
    n, width = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    return n, 4 * max(1, width or 1)


def cores(rows: DataFrame) -> int:
    return max(1, rows.sparkSession.sparkContext.defaultParallelism)


def packed(rows: DataFrame, vectors: list[str], size: int, side: str) -> DataFrame:
    """Blocks of at most ``size`` rows: their ids, each column of vectors as bytes, and a name.

    Vectors that single precision holds whole are stored so.  Rows without a vector are in no block.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kind = dict(rows.dtypes)["id"]
    rows = rows.select("id", *vectors).where(" and ".join(f"{v} is not null" for v in vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                kept.append(batch.slice(at, size - n))
                at, n = at + kept[-1].num_rows, n + kept[-1].num_rows
                if n == size:
                    yield block(kept)
                    kept, n = [], 0
        if n:
            yield block(kept)

    def block(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(kept).combine_chunks()
        ids = table.column("id").combine_chunks()
        out = {f"{side}_name": pa.array([uuid.uuid4().hex]), f"{side}_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
        for c in vectors:
            column = table.column(c).combine_chunks()
            sizes = np.unique(column.value_lengths().to_numpy())
            if len(sizes) > 1:
                raise ValueError("vectors of different lengths")
            whole = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                single = whole.astype(np.float32)
            out[f"{side}_{c}"] = pa.array([(single if np.array_equal(single, whole, equal_nan=True) else whole).tobytes()], pa.binary())
            out[f"{side}_{c}_width"] = pa.array([int(sizes[0])], pa.int32())
        return pa.RecordBatch.from_pydict(out)

    schema = f"{side}_name string, {side}_ids array<{kind}>" + "".join(f", {side}_{c} binary, {side}_{c}_width int" for c in vectors)
    # merged, not shuffled: a part leaves one block that is not full
    return rows.coalesce(max(cores(rows), 1)).mapInArrow(run, schema)


def met(left: DataFrame, right: DataFrame, lefts: int, rights: int) -> DataFrame:
    """Each left block with each right one; a task's pairs with one left block follow one another."""
    return left.repartition(lefts).crossJoin(right.repartition(rights).hint("shuffle_replicate_nl"))


def ids_of(batch: pa.RecordBatch, row: int, side: str) -> np.ndarray:
    return batch.column(f"{side}_ids")[row].values.to_numpy(zero_copy_only=False)


def matrix(batch: pa.RecordBatch, row: int, name: str, n: int) -> np.ndarray:
    """The ``n`` vectors of a block, in double precision."""
    raw, width = batch.column(name)[row].as_buffer(), batch.column(f"{name}_width")[row].as_py()
    kind = np.float64 if n * width and raw.size == 8 * n * width else np.float32
    return np.frombuffer(raw, kind).reshape(n, width).astype(np.float64)


class Nearest:
    """The ``k`` nearest for each row of one block, among the blocks met so far; ties to the smaller id.

    A product of matrices, or for city distances the sum of the larger components, bounds all distances from below in single
    precision; those that may be among the nearest are taken again, each on its own, in double precision.
    """

    STRIP, CITY_STRIP, EXACT = 1024, 512, 1 << 16

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, kind: str) -> None:
        self.ids, self.x, self.k, self.kind = ids, x, k, kind
        self.row, self.other, self.d = np.empty(0, np.int64), ids[:0], np.empty(0)
        self.limit = np.full(len(ids), np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if x.shape[1] != self.x.shape[1]:
            raise ValueError("vectors of different lengths")
        if not len(ids) or not len(self.ids):
            return
        bound = _Bound(self.x, x, self.kind)
        strip, n, pending = self.CITY_STRIP if self.kind == "manhattan" else self.STRIP, len(ids), []
        first = np.isinf(self.limit)
        for start in range(0, len(self.ids), strip):
            pending.append(self._strip(slice(start, min(start + strip, len(self.ids))), bound))
            if sum(len(p[0]) for p in pending) > self.EXACT:
                self._take(*map(np.concatenate, zip(*pending)), ids, x)
                pending = []
        if pending:
            self._take(*map(np.concatenate, zip(*pending)), ids, x)
        if first.any() and n > self.k + 1:
            # where ids repeat, more rows than its own were no neighbours of a row
            short = np.flatnonzero(first & (np.bincount(self.row, minlength=len(self.ids)) < self.k))
            keep = ~(np.isin(self.row, short) & np.isin(self.other, ids))
            self.row, self.other, self.d = self.row[keep], self.other[keep], self.d[keep]
            for q in short:
                self._take(np.full(n, q), np.arange(n), ids, x)

    def _strip(self, own: slice, bound: _Bound) -> tuple[np.ndarray, np.ndarray]:
        """Rows of this strip and of the block that may be near."""
        near = bound.least(own)
        limit = bound.limit(self.limit[own], own)
        new = np.flatnonzero(np.isinf(self.limit[own]))
        if len(new):
            # one more than k, as the row itself may be there
            at = min(self.k, len(near) - 1)
            cut = np.partition(near[:, new], at, axis=0)[at] + bound.slack(own)[new]
            limit[new] = np.where(np.isnan(cut), np.inf, cut)
        may = near <= _up(limit)[None, :]
        may[:, bound.odd_own[own]] = True
        found = np.flatnonzero(may)
        there, mine = found // may.shape[1], found % may.shape[1]
        there = bound.place(there, mine)
        if len(bound.odd):
            # rows with components that are no numbers are bounded by nothing
            there, mine = np.r_[there, np.repeat(bound.odd, may.shape[1])], np.r_[mine, np.tile(np.arange(may.shape[1]), len(bound.odd))]
            both = np.unique(mine * len(near) + there)
            mine, there = both // len(near), both % len(near)
        return mine + own.start, there

    def _take(self, mine: np.ndarray, there: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Merges pairs of own rows and rows of the block."""
        for at in range(0, len(mine), self.EXACT):
            i, j = mine[at : at + self.EXACT], there[at : at + self.EXACT]
            d = each(self.x[i], x[j], self.kind)
            good = ~np.isnan(d) & (d <= self.limit[i]) & (ids[j] != self.ids[i])
            row, other, d = np.r_[self.row, i[good]], np.concatenate([self.other, ids[j[good]]]), np.r_[self.d, d[good]]
            order = np.lexsort((other, d, row))
            row, other, d = row[order], other[order], d[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < self.k
            self.row, self.other, self.d = row[keep], other[keep], d[keep]
            last = rank[keep] == self.k - 1
            self.limit[self.row[last]] = self.d[last]


def each(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """Distances of rows of ``a`` from the rows of ``b`` beside them."""
    with np.errstate(all="ignore"):
        if kind == "manhattan":
            return np.abs(b - a).sum(axis=1)
        if kind == "cosine":
            size = np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum(axis=1))
            return np.where(size > 0, 1 - (b * a).sum(axis=1) / np.where(size > 0, size, 1), 1.0)
        return np.sqrt(((b - a) ** 2).sum(axis=1))


def differences(one: np.ndarray, other: np.ndarray, v: list[np.ndarray], e: list[np.ndarray], same: bool, strip: int = 256) -> tuple[float, float]:
    """Sums over the pairs of two blocks (of one with itself: each pair once): squares of the distances of ``v``, and of what the
    distances of ``e`` differ from them.  Pairs with equal ids do not count."""
    shared = same or bool(len(np.intersect1d(one, other)))
    total = wrong = 0.0
    v, e = (_moved(x) for x in (v, e))
    with np.errstate(invalid="ignore", over="ignore"):
        for start in range(0, len(one), strip):
            own = slice(start, start + strip)
            d, f = _apart(v, own), _apart(e, own)
            if shared:
                counts = one[own, None] < other if same else one[own, None] != other
                d, f = d[counts], f[counts]
            else:
                d, f = d.ravel(), f.ravel()
            total += float(np.dot(d, d))
            f -= d
            wrong += float(np.dot(f, f))
    return total, wrong


def _moved(x: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Both blocks moved to the middle of one, as products of far rows cancel; their squared lengths; the vectors; a square that is
    nothing beside theirs."""
    with np.errstate(invalid="ignore", over="ignore"):
        center = x[0].mean(axis=0)
        a, b = (y - center for y in x)
        return a, b, (a * a).sum(axis=1), (b * b).sum(axis=1), *x, 1e-28 * max(float((y * y).sum(axis=1).max(initial=0)) for y in x)


def _apart(moved: tuple, own: slice) -> np.ndarray:
    """Distances of some rows of one block from the other's, from a product of matrices; of close rows, each on its own."""
    a, b, aa, bb, x, y, nothing = moved
    both = aa[own, None] + bb
    d = a[own] @ b.T
    d *= -2
    d += both
    both *= 1e-10
    both += nothing
    i, j = np.nonzero(d <= both)
    d = np.sqrt(np.maximum(d, 0, out=d), out=d)
    for at in range(0, len(i), Nearest.EXACT):
        r, c = i[at : at + Nearest.EXACT], j[at : at + Nearest.EXACT]
        d[r, c] = each(x[own][r], y[c], "euclidean")
    return d


def _up(limit: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(limit.astype(np.float32), np.float32(np.inf))


class _Bound:
    """For rows q and x: a number for each pair in single precision, and a limit for each q that it is under wherever the distance
    is under q's.  Both sides are moved and scaled alike, so that nothing overflows and little cancels."""

    FAR = np.float32(1e30)

    def __init__(self, q: np.ndarray, x: np.ndarray, kind: str) -> None:
        good_q, good_x = np.isfinite(q).all(axis=1), np.isfinite(x).all(axis=1)
        self.kind, self.odd, self.odd_own = kind, np.flatnonzero(~good_x), ~good_q
        q, x = np.where(good_q[:, None], q, 0.0), np.where(good_x[:, None], x, 0.0)
        dims = q.shape[1]
        if kind == "cosine":
            q, x = (m / np.maximum(np.abs(m).max(axis=1, keepdims=True, initial=0), 1e-300) for m in (q, x))
            q, x = (m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300) for m in (q, x))
            self.scale, self.add, weight = 1.0, np.full(len(q), -1.0), np.ones(len(q))
            size, far = np.zeros((len(x), 1)), 1.0
            self.q = np.concatenate([-q, np.ones((len(q), 1))], axis=1).astype(np.float32)
        else:
            center = x.mean(axis=0)
            if not np.isfinite(center).all():
                center = np.zeros(dims)
            with np.errstate(over="ignore"):
                q, x = q - center, x - center
            self.scale = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0), 1e-300)
            if not 1e-130 < self.scale < 1e150:
                # squares leave the range of doubles: distances are equal that differ here
                self.odd = np.arange(len(x))
            q, x = q / self.scale, x / self.scale
            if kind == "manhattan":
                # |q - x| is twice the larger of both without both
                self.q, self.x = q.astype(np.float32), x.astype(np.float32)
                weight, far = np.abs(q).sum(axis=1), np.abs(x).sum(axis=1).max()
                self.add, self.sum = q.sum(axis=1), x.sum(axis=1).astype(np.float32)
                self.around = np.concatenate([self.x, self.x[: min(len(x), Nearest.CITY_STRIP)]])
            else:
                size = (x * x).sum(axis=1, keepdims=True)
                weight, far = (q * q).sum(axis=1), size.max()
                self.add = -weight
                self.q = np.concatenate([-2 * q, np.ones((len(q), 1))], axis=1).astype(np.float32)
        # rows that are bounded by nothing are to count for no limit either
        if kind == "manhattan":
            self.sum[self.odd] = -self.FAR
        else:
            self.x = np.concatenate([x, size], axis=1).astype(np.float32)
            self.x[self.odd, -1] = self.FAR
        self._slack = 5e-7 * (dims + 8) * (weight + far) + 1e-30

    def slack(self, own: slice) -> np.ndarray:
        return 2 * self._slack[own]

    def limit(self, d: np.ndarray, own: slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            d = d / self.scale
            return (d * d if self.kind == "euclidean" else d) * (1 + 1e-9) + self.add[own] + self._slack[own]

    def least(self, own: slice) -> np.ndarray:
        """A row for each x (for city distances, turned: see ``place``), a column for each q."""
        if self.kind != "manhattan":
            return self.x @ self.q[own].T
        q = self.q[own]
        m, one, larger = len(q), np.ones(q.shape[1], np.float32), np.empty_like(q)
        out = np.empty((len(self.x), m), np.float32)
        if len(self.x) < m:
            for i in range(m):
                out[(np.arange(len(self.x)) - i) % len(self.x), i] = 2 * np.maximum(self.x, q[i]).sum(axis=1) - self.sum
            return out
        # each q with the x that stands as many places on: two arrays in a row, without copies of a q
        for t in range(len(self.x)):
            np.maximum(q, self.around[t : t + m], out=larger)
            np.dot(larger, one, out=out[t])
        out *= 2
        sums = np.concatenate([self.sum, self.sum[:m]])
        out -= np.lib.stride_tricks.sliding_window_view(sums, m)[: len(self.x)]
        return out

    def place(self, there: np.ndarray, mine: np.ndarray) -> np.ndarray:
        return (there + mine) % len(self.x) if self.kind == "manhattan" else there
