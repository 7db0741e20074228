"""Small helpers that every operator of this folder shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` write to the folder that ``spark.checkpoint.dir`` names.

    Only a single-process session (``local[...]``, as in tests) may fall back to a
    temporary folder: on a cluster the executors would not share it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(named)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    For wide or long intermediate tables: smaller on disk than a checkpoint, and
    readers take only the columns that they need.
    """
    use_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def thinned(df: DataFrame, key: list[str], want: int, total: Column) -> DataFrame:
    """About three times ``want`` of ``total`` rows, chosen by a hash of their key.

    Before a bounded sample is taken in an order, so that what the partitions hand on for
    it does not grow with their number.
    """
    place = F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(1 << 30))
    return df.where(place.cast("double") * total < F.lit(3 * want) * F.lit(1 << 30).cast("double"))


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table]) -> Callable:
    """An iterator function for ``mapInArrow`` from one that maps a single batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return run
