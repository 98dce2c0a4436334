"""Lags and running sums over one order of the whole table, without one task that holds it.

The order's leading column is cut into buckets. Within a bucket a window does the work; what crosses
buckets comes from one row per bucket, and only those rows meet in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(order: list[str], *, backwards: bool = False):
    return [F.col(c).desc() if backwards else F.col(c) for c in order]


def _attach(rows: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """What was found per bucket, beside the bucket's rows; null keys meet too."""
    named = per.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    return rows.join(named, same).drop(*[f"__of_{k}" for k in keys])


def with_previous(df: DataFrame, order: list[str], columns: list[str], width: int, suffix: str = "_prev", keys: list[str] = ()) -> DataFrame:
    """Adds each column's value in the row before, over the order by ``order`` (its first a number, cut every ``width``), within ``keys`` if there are any."""
    cut = [*keys, "__bucket"]
    bucketed = df.withColumn("__bucket", F.floor(F.col(order[0]) / width))
    inside = Window.partitionBy(*cut).orderBy(*_order(order))
    picked = F.struct(*columns)
    out = bucketed.withColumn("__prev", F.lag(picked).over(inside))
    lasts = bucketed.groupBy(*cut).agg(F.max_by(picked, F.struct(*order)).alias("__last"))
    carried = lasts.select(*cut, F.lag("__last").over(Window.partitionBy(*keys).orderBy("__bucket")).alias("__carried"))  # a row per bucket
    out = _attach(out, carried, cut)
    prev = F.coalesce("__prev", "__carried")
    return out.select(*df.columns, *[prev[c].alias(c + suffix) for c in columns], "__bucket")


def with_running_sum(df: DataFrame, order: list[str], column: str, name: str, keys: list[str] = ()) -> DataFrame:
    """Adds the running sum of ``column``; ``df`` comes from ``with_previous`` and loses its bucket."""
    cut = [*keys, "__bucket"]
    inside = Window.partitionBy(*cut).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*cut).agg(F.sum(column).alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*cut, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    return _attach(df.withColumn(name, F.sum(column).over(inside)), before, cut).withColumn(name, F.col(name) + F.col("__before")).drop("__bucket", "__before")


def with_highest_before(df: DataFrame, key: str, order: list[str], column: str, name: str, width: int) -> DataFrame:
    """Adds the highest ``column`` among the rows before, within each key; null where there is none."""
    cut = [key, "__bucket"]
    bucketed = df.withColumn("__bucket", F.floor(F.col(order[0]) / width))
    inside = Window.partitionBy(*cut).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, -1)
    tops = bucketed.groupBy(*cut).agg(F.max(column).alias("__top"))
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*cut, F.max("__top").over(earlier).alias("__carried"))
    out = _attach(bucketed.withColumn("__high", F.max(column).over(inside)), carried, cut)
    return out.select(*df.columns, F.greatest("__high", "__carried").alias(name))


def quantiles_by(df: DataFrame, key: str, value: str, shares: dict[str, float], width: float) -> DataFrame:
    """key, n, and for each name of ``shares`` the values at and above its place (``name_low``, ``name_high``) and the interpolated one (``name``).

    Values are counted first and the places found among distinct values, cut every ``width``: neither a key with very many rows
    nor one with very many values is one task. Null values don't count; a key that has no others isn't returned.
    """
    steps = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__c")).withColumn("__bucket", F.floor(F.col(value) / width))
    upto = with_running_sum(steps, [value], "__c", "__upto", [key])
    n = upto.groupBy(key).agg(F.sum("__c").alias("n"))
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    at = lambda where: F.min(F.when(F.col("__upto") > where, F.col(value)))
    found = _attach(upto, n, [key]).groupBy(key, "n").agg(*[at(f(place(q))).alias(f"{name}_{end}") for name, q in shares.items() for end, f in (("low", F.floor), ("high", F.ceil))])
    part = {name: place(q) - F.floor(place(q)) for name, q in shares.items()}
    return found.withColumns({name: F.col(f"{name}_low") + part[name] * (F.col(f"{name}_high") - F.col(f"{name}_low")) for name in shares})


def with_sums_by(df: DataFrame, key: str, order: list[str], width: int, sums: dict) -> DataFrame:
    """Adds running sums (name to column), newest first within each key.

    A key's rows are cut into buckets of ``width`` of the order's leading column; windows run within a bucket, and what newer buckets
    hold comes from one row per key and bucket. So a key with very many rows isn't one task.
    """
    cut = df.select("*", *[c.alias(f"__{n}") for n, c in sums.items()], F.floor(F.col(order[0]) / width).alias("__bucket"))
    inside = Window.partitionBy(key, "__bucket").orderBy(*_order(order, backwards=True)).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(key, "__bucket").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    newer = Window.partitionBy(key).orderBy(F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "__bucket", *[F.coalesce(F.sum(f"__{n}").over(newer), F.lit(0)).alias(f"__{n}_before") for n in sums])
    summed = cut.select(*df.columns, "__bucket", *[F.sum(f"__{n}").over(inside).alias(n) for n in sums])
    summed = _attach(summed, before, [key, "__bucket"])
    return summed.select(*df.columns, *[(F.col(n) + F.col(f"__{n}_before")).alias(n) for n in sums])


def with_trailing(df: DataFrame, key: str, at: str, span: int, sums: dict) -> DataFrame:
    """Adds sums (name to column, of whole numbers) over the rows of the key that lie at most ``span`` before, the row and those beside it included.

    Each row also stands in the next stretch of ``span``, twice: it comes in, and behind all that lie at its end it goes again. So a running sum over
    a stretch tells, and neither a long key nor one with very many rows within ``span`` costs more than its rows.
    """
    cut = df.select("*", *[c.alias(f"__{n}") for n, c in sums.items()], F.floor(F.col(at) / span).alias("__bucket"))
    step = lambda own, bucket, when, sign: F.struct(F.lit(own).alias("own"), bucket.alias("bucket"), when.alias("when"), F.lit(sign).alias("sign"))
    here, later = F.col("__bucket"), F.col("__bucket") + 1
    steps = F.array(step(True, here, F.col(at), 1), step(False, later, F.col(at), 1), step(False, later, F.col(at) + span, -1))
    every = cut.withColumn("__step", F.explode(F.when(here.isNull(), F.slice(steps, 1, 1)).otherwise(steps)))
    near = Window.partitionBy(key, "__step.bucket").orderBy("__step.when", F.desc("__step.sign")).rangeBetween(Window.unboundedPreceding, 0)
    return every.select(*df.columns, "__step", *[F.sum(F.col(f"__{n}") * F.col("__step.sign")).over(near).alias(n) for n in sums]).where("__step.own").drop("__step")
