"""MinHash near-duplicates by an LSH forest.

1. Every document becomes its set of distinct word shingles (64-bit hashes).  Equal sets form a class with one
   representative; only representatives go on.
2. Each representative gets ``HASHES`` minima.  Tree t sorts the representatives by its own sequence of minima.  Those that
   agree in the first ``DEPTH`` minima of a tree lie in one region of its order.
3. The orders are range-partitioned, so no region lands in one task.  In a region of up to ``SMALL`` members all are
   candidates of each other.  In a denser one the depth adapts: each member is compared with the neighbours that share its
   longest prefix, and the region is remembered.
4. Candidates whose minima agree too rarely are dropped (the margin is five standard deviations); the others are confirmed
   on the full sets.  Links give components, by large-star and small-star steps.
5. Remembered regions that still hold several components are finished exactly: every member outside the region's largest
   component is compared, in blocks, with all members of other components, first by their minima, then those that have
   a likely partner by their full sets.  So no pair that a region brings together is lost, no list of all pairs of a
   region is made, and what is linked already is not compared again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import connected_components, forest_edges
from quillspark.llm.shared import bound_batches, hold, materialize, release

TREES, DEPTH = 24, 4
HASHES = TREES * DEPTH
SMALL, NEAR, BLOCK = 8, 2, 512
KNOWN_WORDS = 500_000

_random = np.random.default_rng(20_240_229)
_FACTORS = _random.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_words: dict[bytes, int] = {}


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hold(_words.clear)
    if len(_words) > KNOWN_WORDS:
        _words.clear()
    for word in set(words).difference(_words):
        _words[word] = xxhash.xxh3_64_intdigest(word)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    parts = min(width, len(words))
    out = np.zeros(len(words) - parts + 1, np.uint64)
    for k in range(parts):  # a polynomial whose value is scrambled after each word
        out = (out ^ hashes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(found: np.ndarray) -> np.ndarray:
    """The least 32-bit value of the set under each hash function."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for start in range(0, len(found), 512):
        values = found[start : start + 512] * _FACTORS[:, None]
        values += _SHIFTS[:, None]
        np.minimum(out, (values >> np.uint64(32)).min(axis=1), out=out)
    return out.astype(np.uint32)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def describe(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n_shingles, class_key, minima`` of each document; key and minima are null where there are no words.

    The set's size follows the minima.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, signatures = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), width)
                counts.append(len(found))
                keys.append(hashlib.sha256(found.tobytes()).digest()[:16] if len(found) else None)
                signatures.append(np.append(minima(found), np.uint32(len(found))).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], names=["id", "n_shingles", "class_key", "minima"])
        release()  # learned anew in no time

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, n_shingles long, class_key binary, minima binary")


def set_table(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id, shingle_set`` of the documents in ``wanted``; of rows with one id the class representative's text is any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), width).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingle_set"])
        release()

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), text_col).join(wanted, "id", "left_semi")
    return chosen.mapInArrow(run, "id long, shingle_set binary")


def forest_rows(signatures: DataFrame) -> DataFrame:
    """A row of every representative for each tree: region, position within the region, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            values = _signatures(batch.column(1))[:, :HASHES]
            for tree in range(TREES):
                own = np.take(values, range(tree * DEPTH, tree * DEPTH + DEPTH + 2), axis=1, mode="wrap").astype(np.uint64)
                region = np.full(len(ids), tree + 1, np.uint64)
                for k in range(DEPTH):
                    region = _scramble(region * np.uint64(0x9E3779B97F4A7C15) + own[:, k])
                deeper = (own[:, DEPTH] << np.uint64(32)) | own[:, DEPTH + 1]
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(deeper.view(np.int64)), batch.column(0)], names=["region", "deeper", "id"])

    return signatures.select("id", "minima").mapInArrow(run, "region long, deeper long, id long")


def forest_neighbours(rows: DataFrame, partitions: int) -> DataFrame:
    """``a, b, region``: candidate pairs (region null), and members of dense or cut regions (``b`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            n = len(ids)
            if not n:
                continue
            starts = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
            sizes = np.diff(np.r_[starts, n])
            run_of = np.repeat(np.arange(len(starts)), sizes)
            dense = sizes > SMALL
            dense[0] = dense[-1] = True  # may go on in another batch
            left, right = [], []
            for step in range(1, SMALL):
                same = np.flatnonzero(run_of[:-step] == run_of[step:]) if step < n else np.empty(0, np.int64)
                if step > NEAR:
                    same = same[~dense[run_of[same]]]
                left.append(ids[same])
                right.append(ids[same + step])
            a, b = np.concatenate(left), np.concatenate(right)
            kept = dense[run_of]
            members, regions = ids[kept], region[kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[np.minimum(a, b), members]), pa.array(np.r_[np.maximum(a, b), members], mask=np.r_[np.zeros(len(a), bool), np.ones(len(members), bool)]), pa.array(np.r_[a, regions], mask=np.r_[np.ones(len(a), bool), np.zeros(len(members), bool)])],
                names=["a", "b", "region"],
            )

    ordered = rows.repartitionByRange(partitions, "region", "deeper", "id").sortWithinPartitions("region", "deeper", "id")
    return ordered.mapInArrow(run, "a long, b long, region long")


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES + 1)


def _least_agreement(percent: int) -> float:
    j = percent / 100
    return j - 5 * (j * (1 - j) / HASHES) ** 0.5


def _sizes_fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Sets of such sizes can be similar enough."""
    return 100 * np.minimum(a, b).astype(np.int64) >= percent * np.maximum(a, b).astype(np.int64)


def likely(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose minima agree often enough."""
    least = _least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _signatures(batch.column(2)), _signatures(batch.column(3))
                agree = (a[:, :HASHES] == b[:, :HASHES]).mean(axis=1) >= least
                yield batch.select([0, 1]).filter(pa.array(agree & _sizes_fit(a[:, HASHES], b[:, HASHES], percent)))

    a = signatures.select(F.col("id").alias("a"), F.col("minima").alias("minima_a"))
    b = signatures.select(F.col("id").alias("b"), F.col("minima").alias("minima_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "minima_a", "minima_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, name: str) -> DataFrame:
    """A spanning forest, task by task, of the pairs whose sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(set_table(docs, materialize(wanted, f"{name}-wanted"), width, id_col, text_col), f"{name}-sets")

    def links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keep = []
        for left, right in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            least, most = sorted((len(a), len(b)))
            if 100 * least < percent * most:
                keep.append(False)
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= percent * (least + most - both))
        chosen = batch.filter(pa.array(keep, pa.bool_()))
        return chosen.column(0).to_numpy(), chosen.column(1).to_numpy()

    a = sets.select(F.col("id").alias("a"), F.col("shingle_set").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingle_set").alias("set_b"))
    return forest_edges(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b"), links)


GROUP = ["region", "ask_block", "shelf_block"]


def unfinished(dense: DataFrame, components: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """``region, ask_block, shelf_block, id, component, asks``: members of remembered regions that have a likely partner in
    another component of their region.  ``asks`` marks those outside the region's largest component.

    A region's members are dealt into blocks; each pair of blocks is a group of bounded size.  A member gives a row per
    group at most, however many partners it has.
    """
    least = _least_agreement(percent)
    members = dense.join(components, "id", "left").select("region", "id", F.coalesce("component", "id").alias("component"))
    members = materialize(members, "forest-members")
    parts = members.groupBy("region", "component").agg(F.count("*").alias("n"))
    regions = parts.groupBy("region").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("largest")).where("parts > 1")
    regions = materialize(regions.select("region", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.col("largest.component").alias("main")), "forest-regions")
    members = members.join(regions, "region").join(signatures.select("id", "minima"), "id")
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    shelf = members.select("region", F.explode(every).alias("ask_block"), F.col("block").alias("shelf_block"), "id", "component", "minima", F.lit(False).alias("asks"))
    asks = members.where("component <> main").select("region", F.col("block").alias("ask_block"), F.explode(every).alias("shelf_block"), "id", "component", "minima", F.lit(True).alias("asks"))

    def compare(rows: pa.Table) -> pa.Table:
        asking = rows.column("asks").to_numpy(zero_copy_only=False)
        component, values = rows.column("component").to_numpy(), _signatures(rows.column("minima"))
        there = np.flatnonzero(~asking)
        books, hits = np.ascontiguousarray(values[there].T), np.zeros(len(asking), bool)
        for q in np.flatnonzero(asking):
            agree = np.zeros(len(there), np.int16)
            for k in range(HASHES):
                agree += books[k] == values[q, k]
            hit = (agree >= least * HASHES) & (component[there] != component[q]) & _sizes_fit(books[HASHES], values[q, HASHES], percent)
            hits[there[hit]] = True
            hits[q] = hit.any()
        return rows.select([*GROUP, "id", "component", "asks"]).filter(pa.array(hits))

    asked = asks.select("region", "ask_block").distinct()
    rows = shelf.join(asked, ["region", "ask_block"], "left_semi").unionByName(asks)
    return rows.groupBy(*GROUP).applyInArrow(compare, "region long, ask_block int, shelf_block int, id long, component long, asks boolean")


def finished(rows: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between components, by comparing the full sets of ``rows`` (see ``unfinished``) within each group.

    What a link has joined is not compared again, so a group gives fewer links than it has members.
    """
    wanted = materialize(rows.select("id").distinct(), "forest-rest-wanted")
    sets = materialize(set_table(docs, wanted, width, id_col, text_col), "forest-rest-sets")

    def compare(group: pa.Table) -> pa.Table:
        asking, ids = group.column("asks").to_numpy(zero_copy_only=False), group.column("id").to_numpy()
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingle_set")]
        sizes = np.array([len(x) for x in found])
        label = np.unique(group.column("component").to_numpy(), return_inverse=True)[1]
        numbers = np.unique(np.concatenate(found), return_inverse=True)[1]
        there, ends = np.flatnonzero(~asking), np.cumsum(sizes)
        if not len(there):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        books = np.concatenate([numbers[ends[k] - sizes[k] : ends[k]] for k in there])
        starts = np.r_[0, np.cumsum(sizes[there])[:-1]]
        flags, a, b = np.zeros(numbers.max() + 1, bool), [], []
        for q in np.flatnonzero(asking):
            if (label[there] == label[q]).all():
                continue
            own = numbers[ends[q] - sizes[q] : ends[q]]
            flags[own] = True
            both = np.add.reduceat(flags[books], starts, dtype=np.int64)
            flags[own] = False
            linked = there[(100 * both >= percent * (sizes[there] + sizes[q] - both)) & (label[there] != label[q])]
            for one in np.unique(label[linked], return_index=True)[1]:
                a.append(ids[q])
                b.append(ids[linked[one]])
            label[np.isin(label, label[linked])] = label[q]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    full = rows.join(sets, "id").select(*GROUP, "id", "component", "asks", "shingle_set")
    return full.groupBy(*GROUP).applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row with an id.

    Words are lower-cased in A-Z and split at ASCII white space.  Documents with fewer words than ``width`` have their whole
    sequence as one shingle; those without words, or with a null text, have an empty set and link with nothing.  Two
    documents are linked when ``100 * common >= percent * union`` holds on their full sets.  Ids are integers; a row with a
    null id gets a null component and is not kept.  Rows repeating one id belong to one document per class.  An empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    described = materialize(describe(docs, width, id_col, text_col), "forest-described")
    classes = described.where("class_key is not null and id is not null").groupBy("class_key").agg(F.min(F.struct("id", "minima")).alias("first"))
    classes = materialize(classes.select("class_key", F.col("first.id").alias("id"), F.col("first.minima").alias("minima")), "forest-classes")
    signatures = classes.select("id", "minima")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(forest_neighbours(forest_rows(signatures), partitions), "forest-found")
    pairs = found.where("b is not null and a <> b").select("a", "b").distinct()
    pairs = materialize(likely(pairs, signatures, percent), "forest-likely")
    edges = materialize(confirmed(pairs, docs, width, percent, id_col, text_col, "forest-first"), "forest-edges")
    components = materialize(connected_components(edges), "forest-components")
    dense = found.where("b is null").select("region", F.col("a").alias("id"))
    rest = materialize(unfinished(dense, components, signatures, percent), "forest-rest")
    more = materialize(finished(rest, docs, width, percent, id_col, text_col), "forest-more")
    components = materialize(connected_components(edges.unionByName(more)), "forest-components")
    of_class = classes.select("class_key", "id").join(components, "id", "left").select("class_key", F.coalesce("component", "id").alias("component_id"))
    of_class = materialize(of_class, "forest-of-class")
    out = described.select("id", "n_shingles", "class_key").join(of_class, "class_key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
