"""Pieces of sound before a call, laid end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(pieces: DataFrame, keys: list[str], most_ms: int) -> DataFrame:
    """``pieces``: keys, id, at_ms, dur_ms, recovered. Adds from_ms and to_ms, where a piece comes to lie, and skipped_ms, what is cut off its front; pieces of which nothing is left go.

    Live pieces follow each other: one begins where it says or where the live piece before ends, whichever is later. That recursion is a prefix scan
    in max and plus: an end is the sum of all lengths so far plus the largest gap that any piece so far had left before it. Recovered sound
    only fills what lies before the first live piece, and each only what no earlier one has. Of the whole the last ``most_ms`` stay, in whole pieces and one piece
    at least. A key's pieces are those of one call's pre-roll.
    """
    order = Window.partitionBy(*keys).orderBy("at_ms", F.col("recovered").desc(), "id")
    before, all_of = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    live = ~F.col("recovered")
    first = F.min(F.when(live, F.col("at_ms"))).over(all_of)
    length = F.when(live, F.col("dur_ms")).otherwise(0)
    rows = pieces.withColumn("__first", first).withColumn("__sum", F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = F.max(F.when(live, F.col("at_ms") - (F.col("__sum") - F.col("dur_ms")))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("to_ms", F.when(live, F.col("__sum") + ahead).otherwise(F.least(F.col("at_ms") + F.col("dur_ms"), F.coalesce("__first", F.col("at_ms") + F.col("dur_ms")))))
    filled = F.max(F.when(F.col("recovered"), F.col("to_ms"))).over(before)
    begin = F.when(live, F.col("to_ms") - F.col("dur_ms")).otherwise(F.greatest("at_ms", F.coalesce(filled, F.col("at_ms"))))
    left = rows.withColumn("from_ms", begin).where(live | (F.col("from_ms") < F.col("to_ms")))
    behind = Window.partitionBy(*keys).orderBy(F.desc("from_ms"), F.desc("to_ms"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    held = left.withColumn("__held", F.sum(F.col("to_ms") - F.col("from_ms")).over(behind)).withColumn("__nth", F.count("*").over(behind))
    kept = held.where((F.col("__held") <= most_ms) | (F.col("__nth") == 1))
    return kept.withColumn("skipped_ms", F.when(live, 0).otherwise(F.col("from_ms") - F.col("at_ms"))).drop("__first", "__sum", "__held", "__nth")
