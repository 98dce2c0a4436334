"""Sessions and segments kept open while a stream runs.

What is still open is put out too, under the number that it will keep, so the latest row of a number is the one that holds.
Both are merged batch by batch with the one row a key that the batch before left. Segments' cuts depend on all cuts before, so a slot's
new rows stream past in order, and only the state is held.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.operators.folds import fold_sorted
from tidewake.operators.ordered import with_highest_before, with_running_sum

DAY_MS = 86_400_000
SESSION = "channel string, session long, started_ms long, ended_ms long, score double, n long"
SEGMENT = "slot string, segment_id long, started_ms long, ended_ms long, chunks long, closed boolean"


def _merged(rows: DataFrame, held: DataFrame | None, gap_ms: int) -> DataFrame:
    """Sessions of new ``rows`` and of what each channel ``held`` open, by operators that cut a channel's rows by time."""
    points = rows.select("channel", "event_id", "start_ms", F.col("start_ms").alias("last_ms"), "score", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("no"))
    if held is not None:
        known = held.select(F.col("channel").alias("of"), (F.col("started_ms") - gap_ms).alias("late"))
        points = points.join(known, F.col("channel").eqNullSafe(F.col("of")), "left").where("late is null or start_ms > late").drop("of", "late")
        points = points.union(held.select("channel", F.lit(-1).cast("long"), "started_ms", F.col("ended_ms") - 1000, "score", "n", "session"))
    order = ["start_ms", "event_id"]
    seen = with_highest_before(points, "channel", order, "last_ms", "before", DAY_MS)
    broken = F.coalesce((F.col("start_ms") - F.col("before") >= gap_ms).cast("long"), F.lit(1))
    cut = seen.withColumn("brk", broken).withColumn("__bucket", F.floor(F.col("start_ms") / DAY_MS))
    placed = with_running_sum(cut, order, "brk", "nth", ["channel"])
    # what was held lies in the first session, and its number is that session's
    found = placed.groupBy("channel", "nth").agg(F.max("no").alias("no"), F.min("start_ms").alias("started_ms"), (F.max("last_ms") + 1000).alias("ended_ms"), F.max("score").alias("score"), F.sum("n").alias("n"), F.count_if(F.col("no").isNull()).alias("new"))
    first = F.coalesce(F.max("no").over(Window.partitionBy("channel")), F.lit(1))
    return found.withColumn("session", first + F.col("nth") - 1).where("new > 0").select("channel", "session", "started_ms", "ended_ms", "score", "n")


def open_sessions(stream: DataFrame, folder: str, gap_ms: int = 900_000) -> DataFrame:
    """``stream``: channel, event_id, start_ms, score. Runs over what is there now and returns all sessions; called again with the same folder, it goes on.

    A session ends with a gap of ``gap_ms`` or more; its end is a second after its last row. A row that is older than its channel's open session
    (but not by a gap) belongs to it; an even older one is ignored. Each batch is merged with one row a channel, which the batch before left.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        held = spark.read.schema(SESSION).parquet(f"{folder}/held/{number - 1:09d}") if number else None
        part = f"{folder}/out/part={number:09d}"
        _merged(batch, held, gap_ms).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(part)
        new = spark.read.schema(f"{SESSION}, batch long").parquet(part)
        both = new if held is None else new.union(held.withColumn("batch", F.lit(-1).cast("long")))
        latest = F.max_by(F.struct(*held_fields), F.struct("session", "batch")).alias("s")
        both.groupBy("channel").agg(latest).select("channel", "s.*").write.mode("overwrite").parquet(f"{folder}/held/{number:09d}")

    held_fields = [f.split()[0] for f in SESSION.split(", ")[1:]]
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return _latest(spark, ["channel", "session"], SESSION, folder)


class Updates(NamedTuple):
    """A stream, what a batch of it gives after what is ``held`` (None at first), and the columns that name what is held and what is put out."""

    stream: DataFrame
    merge: Callable[[DataFrame, DataFrame | None], DataFrame]
    key: str
    number: str


def growing_segments(stream: DataFrame, segment_ms: int, first: dict[str, int]) -> Updates:
    """``stream``: slot, event_id, start_ms, end_ms, recovered. Segments grow until they last ``segment_ms``; ids step by two.

    A recovered piece from before the open segment's start is cut at that edge and put in front: the id stays
    and the start moves earlier. One that reaches back behind what was already closed is turned away from there on.
    """

    def step(state, r):
        if state is None:
            no, start, end, chunks, edge = first.get(r["slot"], 1), -1, -1, 0, -1
            if r.get("h_no") is not None:  # where the batch before left off
                no, start, end, chunks, edge = r["h_no"], r["h_start"], r["h_end"], r["h_chunks"], r["h_edge"]
                if r["h_closed"]:
                    no, start, end, chunks, edge = no + 2, -1, -1, 0, end
        else:
            no, start, end, chunks, edge = state
        a, b = max(r["start_ms"], edge), r["end_ms"]
        if b <= a or (chunks and r["recovered"] and a >= start):
            return (no, start, end, chunks, edge), None  # before what is closed, or the live sound is there already
        if chunks and r["recovered"]:
            start, chunks = a, chunks + 1
        else:
            start, end, chunks = (a if not chunks else start), max(end, b), chunks + 1
        full = end - start >= segment_ms
        values = (no, start, end, chunks, full, edge)
        return ((no + 2, -1, -1, 0, end) if full else (no, start, end, chunks, edge)), values

    def merge(batch: DataFrame, held: DataFrame | None) -> DataFrame:
        known = ["segment_id no", "started_ms start", "ended_ms end", "chunks chunks", "closed closed", "edge edge"]
        if held is None:
            joined = batch  # a slot's rows are sorted in one task, so they carry no more than they need
        else:
            left = held.select(F.col("slot").alias("h_slot"), *[F.col(k.split()[0]).alias("h_" + k.split()[1]) for k in known])
            joined = batch.join(left, F.col("slot").eqNullSafe(F.col("h_slot")), "left").drop("h_slot")
        steps = fold_sorted(joined, ["slot"], ["start_ms", "event_id"], ["slot"], step, f"{SEGMENT}, edge long")
        last = F.max_by(F.struct("started_ms", "ended_ms", "chunks", "closed", "edge"), "chunks").alias("s")  # each row that counts adds a chunk
        return steps.groupBy("slot", "segment_id").agg(last).select("slot", "segment_id", "s.*")

    return Updates(stream, merge, "slot", "segment_id")


def run_to_end(updates: Updates, keys: list[str], schema: str, folder: str) -> DataFrame:
    """Runs the stream over what is there now and returns each key's latest row. Called again with the same folder, it goes on.

    Each micro-batch is written once, under its number, whatever is tried again; so is what it leaves for the next, one row a key.
    """
    spark, edged = updates.stream.sparkSession, f"{schema}, edge long"

    def keep(batch: DataFrame, number: int) -> None:
        held = spark.read.schema(edged).parquet(f"{folder}/held/{number - 1:09d}") if number else None
        part = f"{folder}/out/part={number:09d}"
        updates.merge(batch, held).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(part)
        new = spark.read.schema(f"{edged}, batch long").parquet(part)
        both = new if held is None else new.union(held.withColumn("batch", F.lit(-1).cast("long")))
        latest = F.max_by(F.struct(*[c for c in both.columns if c not in (updates.key, "batch")]), F.struct(updates.number, "batch")).alias("s")
        both.groupBy(updates.key).agg(latest).select(updates.key, "s.*").write.mode("overwrite").parquet(f"{folder}/held/{number:09d}")

    updates.stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return _latest(spark, keys, schema, folder)


def _latest(spark: SparkSession, keys: list[str], schema: str, folder: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    found = spark.read.schema(f"{schema}, batch long").option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    rows = found.groupBy(*keys).agg(F.max_by(F.struct(*[n for n in names if n not in keys]), "batch").alias("r"))
    return rows.select(*keys, "r.*").select(*names)


def enriched(stream: DataFrame, dimension: Callable[[], DataFrame], key: str, folder: str, schema: str) -> DataFrame:
    """``stream`` left-joined by ``key`` to a small table that is read anew for each batch, so what has changed in it holds for the rows that come after. Runs over what is there now; called again, it goes on."""

    def attach(batch: DataFrame, number: int) -> None:
        known = dimension().withColumnRenamed(key, "__key")
        batch.join(known, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key").write.mode("overwrite").parquet(f"{folder}/out/part={number:09d}")

    stream.writeStream.foreachBatch(attach).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
