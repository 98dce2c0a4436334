"""Windows that look ahead, over a stream: a frame is decided when the frames that it needs have come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.operators.features import EVERY, HISTORY, MARGIN, candidates, templates

FRAMES = "stream long, n long, level double, ratio double"
DECIDED = "stream long, n long, smooth double, mad double, candidate boolean, open_tail boolean"


def decide(stream: DataFrame, folder: str, level: float, ratio: float) -> DataFrame:
    """``stream``: stream, n, level, ratio, each stream's frames in order. Runs over what is there now and returns all frames decided; called again, it goes on.

    A batch leaves each stream's last frames behind: those not yet decided and those that their windows reach back to. What is
    undecided at the end of what is there is open; it is decided anew once more has come.
    """
    spark = stream.sparkSession
    names = [f.split()[0] for f in FRAMES.split(", ")]

    def step(batch: DataFrame, number: int) -> None:
        new = batch.select(*names, F.lit(False).alias("done"))
        held = spark.read.schema(f"{FRAMES}, done boolean").parquet(f"{folder}/held/{number - 1:09d}") if number else None
        found = candidates(new if held is None else new.unionByName(held), ["stream"], level, ratio)
        found.write.mode("overwrite").parquet(f"{folder}/found/{number:09d}")
        found = spark.read.schema(found.schema).parquet(f"{folder}/found/{number:09d}")
        decided = found.where("not done and ahead").select("stream", "n", "smooth", "mad", "candidate", F.lit(False).alias("open_tail"))
        decided.write.mode("overwrite").parquet(f"{folder}/out/part={number:09d}")
        last = found.groupBy("stream").agg(F.max("n").alias("last"))
        kept = found.join(last, "stream").where(F.col("n") > F.col("last") - 2 * MARGIN)
        kept.select(*names, F.col("ahead").alias("done")).write.mode("overwrite").parquet(f"{folder}/held/{number:09d}")
        open_ = found.where("not ahead").select("stream", "n", "smooth", "mad", F.lit(False).alias("candidate"), F.lit(True).alias("open_tail"))
        open_.withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/open/{number:09d}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(DECIDED).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    # a stream's tail of any batch is open until its frames are decided
    tails = spark.read.schema(f"{DECIDED}, number long").option("recursiveFileLookup", "true").parquet(f"{folder}/open")
    undecided = tails.join(out.select("stream", "n"), ["stream", "n"], "left_anti").groupBy("stream", "n").agg(F.max_by(F.struct("smooth", "mad", "candidate", "open_tail"), "number").alias("t"))
    return out.union(undecided.select("stream", "n", "t.*"))


TEMPLATES = "stream long, n long, ratio double, level double, frames long, loud long, valid boolean"


def renewed_templates(stream: DataFrame, folder: str, every: int = EVERY, history: int = HISTORY) -> DataFrame:
    """``stream``: as in ``decide``. The noise templates of all frames that there are now, each over the frames before it; called again, it goes on.

    A batch leaves each stream's last ``history`` frames for the next.
    """
    spark, names = stream.sparkSession, [f.split()[0] for f in FRAMES.split(", ")]

    def step(batch: DataFrame, number: int) -> None:
        frames = batch.select(*names, F.lit(True).alias("new"))
        if number:
            frames = frames.union(spark.read.schema(FRAMES).parquet(f"{folder}/held/{number - 1:09d}").select(*names, F.lit(False)))
        first = frames.where("new").groupBy("stream").agg(F.min("n").alias("first"))  # a row a stream
        made = templates(frames, "stream", every=every, history=history).join(first, "stream").where("n >= first").drop("first")
        made.write.mode("overwrite").parquet(f"{folder}/out/part={number:09d}")
        last = frames.groupBy("stream").agg(F.max("n").alias("last"))
        frames.join(last, "stream").where(F.col("n") > F.col("last") - history).select(*names).write.mode("overwrite").parquet(f"{folder}/held/{number:09d}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(TEMPLATES).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
