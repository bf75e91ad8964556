"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: the ASCII space and \x09-\x0D.  ``bytes.split()`` splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch; only a row larger than that makes a larger batch.
BATCH_BYTES = 2 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where that is unset, a folder of this machine on a
    local master, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = current or f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    This cuts the lineage, survives lost executors, and forgets the partitioning, so that a later join shuffles both of
    its sides and adaptive execution can split the skewed ones.  Whole texts are best packed by zstd.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # in Spark 4.1 a union of branches of one dealt table claims a partitioning that it may lack
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of one Arrow batch, as texts may be long.  The same for all operators, so that a plan that runs later
    runs as it was made."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_holder: list[Callable[[], None]] = []


def hold(forget: Callable[[], None]) -> None:
    """From now on this Python worker keeps what ``forget`` drops; what another operator has kept in it goes.

    Workers live on from stage to stage, and idle ones count to their executor's memory too.
    """
    if _holder != [forget]:
        release()
        _holder.append(forget)


def release() -> None:
    """Drops what this Python worker keeps, and gives the memory back."""
    if _holder:
        _holder.pop()()
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()


def held_out(doc_id: str, modulus: int, remainder: int):
    """crc32 of the id's decimal text, modulo ``modulus``, equals ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder
