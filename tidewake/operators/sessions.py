"""Sessions, gaps, slices and batches of intervals in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators.ordered import with_highest_before, with_previous, with_running_sum

BUCKET_MS = 86_400_000


def global_sessions(rows: DataFrame, same: Column, columns: list[str], order: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Numbers sessions over one order of all rows: a row continues the session of the row right before if ``same`` holds.

    ``same`` may name the ``columns`` with ``_prev`` for the row before. Rows of other channels between two of
    one session do split it.
    """
    linked = with_previous(rows, order, columns, bucket_ms)
    broken = linked.withColumn("__break", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1).cast("long"))
    return with_running_sum(broken, order, "__break", "session").drop("__break", *[c + "_prev" for c in columns])


def keyed_sessions(rows: DataFrame, key: str, start: str, seen: str, gap_ms: int, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Numbers sessions within a key: a row continues while the gap since the row before is under ``gap_ms``."""
    order = [start, "event_id"]
    linked = with_previous(rows.withColumn("__seen", F.col(seen)), order, ["__seen"], bucket_ms, keys=[key])
    broken = linked.withColumn("__break", F.coalesce((F.col(start) - F.col("__seen_prev") >= gap_ms).cast("long"), F.lit(1)))
    return with_running_sum(broken, order, "__break", "session", [key]).drop("__break", "__seen", "__seen_prev")


def edge_quiet(activity: Column, length: Column) -> Column:
    """leading, trailing: how much of ``length`` lies before the first and behind the last active bin; all of it if no bin is active, 0 without bins."""
    bins = F.size(activity)
    part = lambda xs: F.coalesce(F.nullif(F.array_position(F.transform(xs, lambda x: F.coalesce(x > 0, F.lit(False))), True), F.lit(0)) - 1, bins.cast("long"))
    told = lambda xs: F.when(bins > 0, F.try_divide(part(xs) * length, bins)).otherwise(0.0)
    return F.struct(told(activity).alias("leading"), told(F.reverse(activity)).alias("trailing"))


def trimmed(length: Column, start: Column, stop: Column) -> Column:
    """first, last: the active part of a record of this length; unknown ends are the record's, and none lies outside or before the first."""
    first = F.greatest(F.lit(0), F.least(length, F.coalesce(start, F.lit(0))))
    return F.struct(first.alias("first"), F.greatest(first, F.least(length, F.coalesce(stop, length))).alias("last"))


def downsampled(xs: Column, most: int) -> Column:
    """``most`` bins at most, each the highest of the values that it touches; a shorter array stays as it is."""
    width = F.size(xs) / F.lit(float(most))
    first = lambda i: F.floor(i * width).cast("int")
    last = lambda i: F.greatest(first(i) + 1, F.ceil((i + 1) * width).cast("int"))
    fewer = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.array_max(F.slice(xs, first(i) + 1, last(i) - first(i))))
    return F.when(F.size(xs) > most, fewer).otherwise(xs)


def quiet_gaps(rows: DataFrame, key: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Gaps between a row's start and the latest end before it, where positive: key, event_id, gap_ms."""
    seen = with_highest_before(rows, key, ["start_ms", "event_id"], "end_ms", "latest", bucket_ms)
    return seen.withColumn("gap_ms", F.col("start_ms") - F.col("latest")).where("gap_ms > 0").select(key, "event_id", "gap_ms")


def fixed_slices(spans: DataFrame, keys: list[str], slice_bytes: int) -> DataFrame:
    """Spans cut every ``slice_bytes`` of their segment: keys, slice, span_no, bytes."""
    cut = spans.withColumn("slice", F.explode(F.sequence(F.floor(F.col("byte_start") / slice_bytes), F.floor((F.col("byte_end") - 1) / slice_bytes))))
    part = F.least("byte_end", (F.col("slice") + 1) * slice_bytes) - F.greatest("byte_start", F.col("slice") * slice_bytes)
    return cut.select(*keys, "slice", "span_no", part.alias("bytes"))


def silence_breaks(spans: DataFrame, keys: list[str], is_open: Column, limit_bytes: int) -> DataFrame:
    """After an open span, closed bytes add up; at ``limit_bytes`` the segment is flushed and the count starts anew.

    keys, span_no, closed_bytes (since the last open span), flush (true where the limit is reached first).
    """
    order = Window.partitionBy(*keys).orderBy("span_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = spans.withColumn("open", is_open).withColumn("island", F.sum(F.col("open").cast("long")).over(order))
    within = Window.partitionBy(*keys, "island").orderBy("span_no").rowsBetween(Window.unboundedPreceding, 0)
    closed = F.sum(F.when(F.col("open"), 0).otherwise(F.col("bytes"))).over(within)
    reached = (F.col("island") > 0) & ~F.col("open") & (closed >= limit_bytes) & (closed - F.col("bytes") < limit_bytes)
    return marked.withColumn("closed_bytes", closed).withColumn("flush", reached).select(*keys, "span_no", "closed_bytes", "flush")
