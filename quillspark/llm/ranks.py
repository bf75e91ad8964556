"""Ranks of rows within groups, from sorted partitions and prefix sums of their sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.shared import materialize


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank``, from 0, of each row in its group by ``order``; nulls first, and null groups are one group.

    Rows are dealt by ranges of group, order and a number of their own, so one group, or many equal rows, may fill many
    partitions.  Each partition counts along its sorted rows.  Only its first group can have begun before, so one row for each
    partition says how many rows of that group came earlier; these are prefix sums that start anew where the group changes.
    ``df`` should be a written table, as ranges are found by a first reading.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "row_number"]
    rows = df.withColumn("row_number", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("row_number")
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("at", T.LongType()), T.StructField("first", T.BooleanType())])
    names, column = schema.fieldNames(), rows.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, at, first, last = TaskContext.get().partitionId(), 0, 0, True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(column)
            codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new = np.r_[bool(place) and values[0].as_py() != last, codes[1:] != codes[:-1]]
            begins = np.flatnonzero(new)
            since = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            ats = np.where(since < 0, at + np.arange(n), np.arange(n) - since)
            firsts = np.full(n, first)
            if len(begins):
                firsts[begins[0] :], first = False, False
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(place + np.arange(n)), pa.array(ats), pa.array(firsts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)
            place, at, last = place + n, int(ats[-1]) + 1, values[n - 1].as_py()

    placed = materialize(rows.mapInArrow(run, schema), f"{name}-placed")
    ends = placed.groupBy("part").agg(
        F.min_by(F.struct(F.col(group).alias("g")), "place").alias("head"),
        F.max_by(F.struct(F.col(group).alias("g"), F.col("at")), "place").alias("tail"),
        F.bool_and("first").alias("single"),
    )
    along = Window.orderBy("part")  # a row for each partition
    ends = ends.withColumn("goes_on", F.coalesce(F.col("head.g").eqNullSafe(F.lag("tail.g").over(along)) & F.lag("part").over(along).isNotNull(), F.lit(False)))
    ends = ends.withColumn("run", F.sum(F.when(F.col("goes_on") & F.col("single"), 0).otherwise(1)).over(along))
    ends = ends.withColumn("sum", F.sum(F.col("tail.at") + 1).over(Window.partitionBy("run").orderBy("part")))
    ends = ends.select("part", F.when(F.col("goes_on"), F.lag("sum").over(along)).otherwise(0).alias("before"))
    bases = F.broadcast(materialize(ends, f"{name}-bases"))  # no more rows than partitions
    out = placed.join(bases, "part")
    return out.select(*df.columns, (F.col("at") + F.when(F.col("first"), F.col("before")).otherwise(0)).alias("rank"))
