"""Folders that every executor can reach, and what all corpus operators have in common."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = threading.local()


def _scratch() -> list[tuple[SparkSession, str] | None]:
    """The folders made by this thread, so that two runs side by side don't delete each other's."""
    if not hasattr(_OWN, "made"):
        _OWN.made = []
    return _OWN.made


def column(name: str) -> Column:
    """The column of this very name, whatever dots or quotes are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct."""
    return F.struct(*map(column, df.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir`` or, where that is unset, below the context's checkpoint directory.

    Without either, local mode works below the machine's temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tidewake-{tag}-{uuid.uuid4().hex}"
    _scratch().append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: its lineage ends there, so a lost
    executor costs no recomputation and no step runs twice."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs now rather than at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def smallest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of ``df`` by a hash of the columns ``order``, then by these. ``df`` is read twice.

    Only rows whose hash lies below where the first ``n`` are expected meet in one task, so that doesn't grow
    with the number of tasks. Should fewer than ``n`` lie there, all are ordered.
    """
    place = F.shiftrightunsigned(F.xxhash64(*order), 11)  # 53 bits: exact as a double
    total = df.count()
    share = (n + 6 * n**0.5 + 20) / max(1, total)
    if share < 1:
        near = df.where(place < int(share * (1 << 53)))
        if near.count() >= n:
            df = near
    return df.orderBy(place, *order).limit(n)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``materialize`` made and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidewake-" in folder:
            _delete(spark, folder)


def mark() -> int:
    """How many folders this thread has made, for ``release``."""
    return len(_scratch())


def release(start: int, stop: int) -> None:
    """Deletes the folders made between two marks. Only for callers that have written what was made from them."""
    made = _scratch()
    for k in range(start, min(stop, len(made))):
        if made[k]:
            _delete(*made[k])
            made[k] = None


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
