"""Embedding near-duplicates by an exact metric range join.

On unit vectors cosine >= c means a Euclidean distance of at most r = sqrt(2 - 2c).  Equal vectors of one label form a class
with one representative.  Representatives are sorted by label and packed into blocks, each label's next to those with the same
nearest pivot, and a block has a ball around its vectors.  Pairs of blocks meet in a Cartesian product, whose tasks read the shuffled
blocks where they lie, so that each vector is stored once for a side; by the triangle inequality those can be left out whose balls
are more than r apart.  All of a pair's cosines come from one product of matrices in single precision; where that leaves it open, the
cosine itself decides, in double precision on the original vectors.  A pair gives the number of links of each of its vectors and a
spanning forest of them, not the links themselves.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import connected_components
from quillspark.llm.shared import bound_batches, materialize

#: Vectors that are arranged by pivots at once, vectors by pivot, and vectors of a block at most.
ARRANGED, CELL, BLOCK = 8192, 512, 1024
#: Bytes of vectors that a task holds of one side, and tasks by core.
PART, TASKS = 64 << 20, 8


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is not null, has no null or non-finite component and is not zero; as array<double> in ``v``."""
    v = vectors.withColumn("v", F.col(vector_col).cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return v.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that very large or small components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between ids that join what the matrix links, one fewer than the ids of each component."""
    a, b = [], []
    row_left, column_left = linked.any(axis=1), linked.any(axis=0)
    while row_left.any():
        ahead = [(True, int(row_left.argmax()))]
        row_left[ahead[0][1]] = False
        while ahead:
            is_row, at = ahead.pop()
            own, left = (linked[at], column_left) if is_row else (linked[:, at], row_left)
            new = np.flatnonzero(own & left)
            left[new] = False
            a += [rows[at] if is_row else columns[at]] * len(new)
            b += (columns if is_row else rows)[new].tolist()
            ahead += [(not is_row, k) for k in new.tolist()]
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return a[a != b], b[a != b]


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Rows link when their labels are equal and not null, their vectors have one length and their cosine is at least
    ``cosine``.  A vector that is null, zero or holds null or non-finite components links with nothing; nor does a row with
    a null id.  Rows repeating an id are separate rows that share their component.  An empty table gives no rows.
    """
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("raw"))
    good = usable(rows.where("id is not null and label is not null"), "raw").withColumn("space", F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string")))
    good = good.select("id", "space", "raw", F.sha1(F.concat_ws(",", F.col("space"), F.transform("v", lambda x: (x + 0.0).cast("string")))).alias("class_key"))
    keyed = materialize(good.select("id", "class_key"), "pivot-rows")
    # vectors stay of their own type until they are packed, which may be half as wide
    classes = good.groupBy("class_key").agg(F.min(F.struct("id", "space", "raw")).alias("first"), F.count("*").alias("n"))
    classes = materialize(classes.select(F.col("first.id").alias("id"), F.col("first.space").alias("space"), F.col("first.raw").alias("raw"), "n", "class_key"), "pivot-classes")
    links = materialize(_links(classes, cosine), "pivot-links")

    counts = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("m").alias("m"))
    components = connected_components(links.where("b is not null").select("a", "b"))
    of_class = classes.join(counts, "id", "left").join(components, "id", "left")
    of_class = materialize(of_class.select("class_key", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "pivot-of-class")
    found = keyed.select("id", "class_key").join(of_class, "class_key").select("id", "n_links", "component_id")
    found = materialize(found.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "pivot-found")
    out = rows.select("id").join(found, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _blocks(classes: DataFrame) -> DataFrame:
    """Blocks of vectors of one length, with their spaces in order and the count of each."""
    spark = classes.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(classes.count() / (2 * ARRANGED)))
    order = ["space", F.xxhash64("id", "class_key")]
    rows = classes.select("space", "id", "n", "raw", "class_key").repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("class_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            for batch in of_one_length(batch):
                if kept and width(kept[-1]) != width(batch):
                    yield from blocks(kept)
                    kept, n = [], 0
                at = 0
                while at < batch.num_rows:
                    kept.append(batch.slice(at, ARRANGED - n))
                    at, n = at + kept[-1].num_rows, n + kept[-1].num_rows
                    if n == ARRANGED:
                        yield from blocks(kept)
                        kept, n = [], 0
        if kept:
            yield from blocks(kept)

    def width(batch: pa.RecordBatch) -> int:
        return len(batch.column("raw")[0])

    def of_one_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = batch.column("raw").value_lengths().to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
        return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)

    def blocks(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(kept).combine_chunks()
        wide = np.array(_matrix(rows.column("raw")), np.float64)
        u, space = unit(wide), rows.column("space").to_numpy()
        starts = np.flatnonzero(np.r_[True, space[1:] != space[:-1]])
        order = np.arange(len(u))
        for a, b in zip(starts, np.r_[starts[1:], len(u)]):
            if b - a > CELL:
                pivots = u[a:b][:: CELL]
                order[a:b] = a + np.argsort((u[a:b] @ pivots.T).argmax(axis=1), kind="stable")
        ids, n = rows.column("id").to_numpy()[order], rows.column("n").to_numpy()[order]
        wide, u, space = wide[order], u[order], space[order]
        for a in range(0, len(u), BLOCK):
            own = slice(a, a + BLOCK)
            starts = np.flatnonzero(np.r_[True, space[own][1:] != space[own][:-1]])
            center = u[own].mean(axis=0)
            radius = float(np.sqrt(((u[own] - center) ** 2).sum(axis=1).max()))
            with np.errstate(over="ignore"):
                single = wide[own].astype(np.float32)
            exact = np.array_equal(single, wide[own])
            names = space[own][starts].tolist()
            yield pa.RecordBatch.from_pydict({
                "name": [uuid.uuid4().hex], "ids": pa.array([ids[own]], pa.list_(pa.int64())), "n": pa.array([n[own]], pa.list_(pa.int64())),
                "spaces": pa.array([names], pa.list_(pa.string())), "counts": pa.array([np.diff(np.r_[starts, len(ids[own])])], pa.list_(pa.int64())), "first": [names[0]], "last": [names[-1]],
                "width": pa.array([u.shape[1]], pa.int32()), "center": pa.array([center]), "radius": [radius], "bytes": pa.array([4 * single.size], pa.int64()),
                "v": pa.array([(single if exact else wide[own]).tobytes()], pa.binary()),
            })

    return rows.mapInArrow(run, "name string, ids array<long>, n array<long>, spaces array<string>, counts array<long>, first string, last string, width int, center array<double>, radius double, bytes long, v binary")


class _Block:
    """A block as it is compared."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str) -> None:
        get = lambda c: batch.column(f"{side}_{c}")[row]
        self.name, width, raw = get("name").as_py(), get("width").as_py(), get("v").as_buffer()
        self.ids, self.n = (get(c).values.to_numpy() for c in ("ids", "n"))
        self.unit = unit(np.frombuffer(raw, np.float64 if raw.size == 8 * len(self.ids) * width else np.float32).reshape(-1, width).astype(np.float64))
        self.single = self.unit.astype(np.float32)
        ends = np.cumsum(get("counts").values.to_numpy())
        self.spaces = {s: slice(a, b) for s, a, b in zip(get("spaces").as_py(), [0, *ends[:-1].tolist()], ends.tolist())}


def linked_pairs(one: _Block, other: _Block, r: slice, g: slice, cosine: float) -> np.ndarray:
    """Which rows of two blocks have the cosine."""
    close = one.single[r] @ other.single[g].T
    open_ = 1e-6 + 2.4e-7 * (one.unit.shape[1] + 8)
    linked = close >= cosine + open_
    i, j = np.nonzero((close >= cosine - open_) & ~linked)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        linked[a, b] = np.einsum("kd,kd->k", one.unit[r][a], other.unit[g][b]) >= cosine
    return linked


def _links(classes: DataFrame, cosine: float) -> DataFrame:
    """Of each pair of blocks, rows ``a, m``: how many vectors in it link with a's class, each link counted once in all; and rows
    ``a, b``: a spanning forest of the links."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    blocks = materialize(_blocks(classes), "pivot-blocks")
    count, size = blocks.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    rights = max(1, math.ceil(size / PART))
    lefts = max(1, min(count, math.ceil(TASKS * classes.sparkSession.sparkContext.defaultParallelism / rights)))
    side = lambda s: blocks.select(*(F.col(c).alias(f"{s}_{c}") for c in blocks.columns if c != "bytes"))
    # of the two orders of a pair one, so that all blocks come first in about as many pairs
    same, first = F.col("l_name") == F.col("r_name"), F.col("l_name") < F.col("r_name")
    even = F.pmod(F.crc32("l_name") + F.crc32("r_name"), F.lit(2)) == 0
    apart = F.sqrt(F.aggregate(F.zip_with("l_center", "r_center", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    meet = (same | (first == even)) & (F.col("l_width") == F.col("r_width")) & (F.col("l_first") <= F.col("r_last")) & (F.col("r_first") <= F.col("l_last"))
    meet = meet & (apart <= F.col("l_radius") + F.col("r_radius") + F.lit(radius + 1e-9))
    pairs = side("l").repartition(lefts).crossJoin(side("r").repartition(rights).hint("shuffle_replicate_nl")).where(meet)
    pairs = pairs.select(*(f"{s}_{c}" for s in "lr" for c in ("name", "ids", "n", "spaces", "counts", "width", "v")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for batch in batches:
            for row in range(batch.num_rows):
                if one is None or batch.column("l_name")[row].as_py() != one.name:
                    one = _Block(batch, row, "l")
                other = one if batch.column("r_name")[row].as_py() == one.name else _Block(batch, row, "r")
                for space in one.spaces.keys() & other.spaces.keys():
                    yield from found(one, other, one.spaces[space], other.spaces[space])

    def found(one: _Block, other: _Block, r: slice, g: slice) -> Iterator[pa.RecordBatch]:
        linked = linked_pairs(one, other, r, g, cosine)
        if not linked.any():
            return
        ids, others = one.ids[r], other.ids[g]
        # within a block a pair is met twice: the smaller id's side counts
        once = linked & (ids[:, None] < others[None, :] if one is other else ids[:, None] != others[None, :])
        met = np.r_[once @ other.n[g], one.n[r] @ once]
        who = np.r_[ids, others]
        a, b = forest(linked, ids, others)
        some = met > 0
        if some.any() or len(a):
            none, zero = np.zeros(some.sum(), np.int64), np.zeros(len(a), np.int64)
            yield pa.RecordBatch.from_pydict({"a": np.r_[who[some], a], "b": pa.array(np.r_[none, b], mask=np.r_[np.ones(len(none), bool), np.zeros(len(b), bool)]), "m": np.r_[met[some], zero]})

    return pairs.mapInArrow(compare, "a long, b long, m long")
