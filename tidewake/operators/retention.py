"""What is kept: rules by age, count and bytes, each with its own bounds.

Every rule works within a key, whose rows are ordered bucket by bucket; a table that is to be cut as one has a constant key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.operators.ordered import with_sums_by
from tidewake.sources.folders import shared_folder

DAY_MS = 86_400_000


def keep_newest_bytes(rows: DataFrame, key: str, order: list[str], size: str, limit: float, keep_one: bool = False, width: int = 30 * DAY_MS) -> DataFrame:
    """The longest run of newest rows within ``limit``; with ``keep_one``, the newest row even if it alone is larger. ``order`` leads with a time, cut every ``width``."""
    held = with_sums_by(rows, key, order, width, {"__held": F.col(size), "__nth": F.lit(1)})
    keep = F.col("__held") <= limit
    if keep_one:
        keep = keep | (F.col("__nth") == 1)
    return held.where(keep).drop("__held", "__nth")


def keep_ttl(rows: DataFrame, end: str, reference: int, ttl: int, inclusive: bool) -> DataFrame:
    """Rows that ended within ``ttl`` of ``reference``; the bound itself counts if ``inclusive``. A null end is open and stays."""
    edge = F.col(end) >= reference - ttl if inclusive else F.col(end) > reference - ttl
    return rows.where(F.col(end).isNull() | edge)


def keep_count(rows: DataFrame, key: str, order: list[str], n: int, is_open=None, width: int = 30 * DAY_MS) -> DataFrame:
    """The n newest; rows for which ``is_open`` holds stay whatever their age, and count."""
    ranked = with_sums_by(rows, key, order, width, {"__rank": F.lit(1)})
    keep = F.col("__rank") <= n
    return ranked.where(keep if is_open is None else keep | is_open).drop("__rank")


def keep_closed(rows: DataFrame, key: str, order: list[str], end: str, reference: int, ttl: int, n: int, width: int = 30 * DAY_MS) -> DataFrame:
    """Rows that are open (a null ``end``), whatever their age and number, and closed ones that ended within ``ttl``: if there are more than ``n`` in all, the newest of these."""
    fresh = keep_ttl(rows, end, reference, ttl, inclusive=True)
    ranked = with_sums_by(fresh, key, order, width, {"__closed": F.when(F.col(end).isNotNull(), 1).otherwise(0)})
    held = fresh.groupBy(key).agg(F.count_if(F.col(end).isNull()).alias("__open")).withColumnRenamed(key, "__of")  # a row a key
    joined = ranked.join(held, F.col(key).eqNullSafe(F.col("__of")))
    return joined.where(F.col(end).isNull() | (F.col("__closed") + F.col("__open") <= n)).drop("__closed", "__open", "__of")


def keep_fitting(rows: DataFrame, key: str, order: list[str], size: str, limit: int, width: int = 30 * DAY_MS) -> DataFrame:
    """Newest to oldest, each row that still fits: one that would overflow is left out and the next is tried.

    In rounds: of the rows no larger than the room left, the newest that fit together stay; what comes behind them is smaller than
    the room that they leave, or never fits. Each round keeps at least a row of each key that has any, mostly about half of the room.
    No round gathers a key's rows in one task.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "fitting")
    ids = [key, *order]
    rest = rows.select(*ids, F.col(size).cast("long").alias("__size"), F.lit(limit).cast("long").alias("__room"))
    step = 0
    while True:
        able = rest.where("__size <= __room")
        tried = with_sums_by(able, key, order, width, {"__held": F.col("__size")}).withColumn("__fits", F.col("__held") <= F.col("__room"))
        tried.write.parquet(f"{folder}/round={step}")
        tried = spark.read.schema(tried.schema).parquet(f"{folder}/round={step}")
        left = tried.groupBy(key).agg((F.max("__room") - F.coalesce(F.sum(F.when(F.col("__fits"), F.col("__size"))), F.lit(0))).alias("__left")).withColumnRenamed(key, "__of")
        rest = tried.where("not __fits").join(left, F.col(key).eqNullSafe(F.col("__of"))).select(*ids, "__size", F.col("__left").alias("__room"))
        if rest.where("__size <= __room").isEmpty():
            break
        step += 1
    kept = spark.read.schema(tried.schema).parquet(*[f"{folder}/round={k}" for k in range(step + 1)]).where("__fits").select(*[F.col(c).alias(f"__{c}") for c in ids])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ids]
    return rows.join(kept, same, "left_semi")
