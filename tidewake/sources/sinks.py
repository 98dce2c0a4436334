"""What is written: versions that a reader sees whole or not at all, changed payloads only, admissions and checked copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators.retention import DAY_MS, keep_newest_bytes


def publish(rows: DataFrame, folder: str, version: int, form: str = "parquet") -> None:
    """``rows`` as the folder's version of that number. Its number is written last and in one file, so a version is seen whole or not at all.

    Written again (a batch that is tried again), a version takes its own place.
    """
    rows.write.mode("overwrite").format(form).save(f"{folder}/versions/{version:012d}")
    number = rows.sparkSession.range(1, numPartitions=1).select(F.lit(version).cast("long").alias("version"))
    number.write.mode("append").parquet(f"{folder}/published")


def newest(spark: SparkSession, folder: str, schema: str, form: str = "parquet") -> DataFrame:
    """The rows of the newest version; an error if there is none."""
    version = spark.read.schema("version long").parquet(f"{folder}/published").agg(F.max("version")).first()[0]
    return spark.read.schema(schema).format(form).load(f"{folder}/versions/{version:012d}")


def publish_stream(rows: DataFrame, folder: str, every: str | None = None):
    """Publishes each batch's rows; of what changes between two triggers only the latest is written. Without ``every``, to the end of what is there."""
    writer = rows.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, number: publish(batch, folder, number)).start()


def snapshot(rows: DataFrame, folder: str, version: int, before: DataFrame | None = None, largest: int = 1 << 62, worth: float = 0.0) -> DataFrame:
    """``rows``: key, payload. Writes the payloads that ``before`` (an earlier manifest) doesn't hold alike, then the manifest, which it returns.

    A manifest has key, digest, bytes and stored: the version whose payloads hold it. Rows without a payload or with one beyond ``largest`` aren't
    listed. What is still wanted of a version of whose bytes less than the share ``worth`` is wanted, is written again, so that ``sweep`` can delete that version's.
    """
    spark = rows.sparkSession
    fit = rows.where((F.octet_length("payload") > 0) & (F.octet_length("payload") <= largest)).withColumn("digest", F.sha2("payload", 256))
    if before is None:
        found = fit.withColumn("held", F.lit(None).cast("long"))
    else:
        found = fit.join(before.select("key", "digest", F.col("stored").alias("held")), ["key", "digest"], "left")
        if worth:
            written = spark.read.schema("version long, bytes long").parquet(f"{folder}/written").groupBy("version").agg(F.max("bytes").alias("bytes"))
            wanted = found.where("held is not null").groupBy("held").agg(F.sum(F.octet_length("payload")).alias("wanted"))
            thin = wanted.join(written, F.col("held") == F.col("version")).where(F.col("wanted") < worth * F.col("bytes")).select(F.col("held").alias("thin"))
            # a row for each version; a shuffle by version would bring all of its payloads to one task
            found = found.join(F.broadcast(thin), F.col("held") == F.col("thin"), "left").withColumn("held", F.when(F.col("thin").isNull(), F.col("held"))).drop("thin")
    fresh = found.where("held is null").select("key", "payload")
    fresh.write.mode("overwrite").parquet(f"{folder}/payloads/stored={version}")
    manifest = found.select("key", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.coalesce("held", F.lit(version)).cast("long").alias("stored"))
    publish(manifest, folder, version)
    listed = newest(spark, folder, manifest.schema.simpleString()[7:-1].replace(":", " "))
    size = listed.where(F.col("stored") == version).agg(F.lit(version).cast("long").alias("version"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
    size.write.mode("append").parquet(f"{folder}/written")
    return listed


def sweep(spark: SparkSession, folder: str, keep: int = 1, held: tuple[int, ...] = ()) -> list[str]:
    """Deletes the manifests but those of the newest ``keep`` versions and of those that readers say they ``held``, and the payloads that none of these names. Returns what went.

    Nothing of the newest version or of one that is being written (of a later number) is touched, and a sweep that was cut off is done by the next.
    What it holds is a number for each version that is there.
    """

    def there(part: str, prefix: str) -> dict[int, object]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [status.getPath() for status in files.listStatus(path)] if files.exists(path) else []
        return {int(p.getName()[len(prefix) :]): p for p in found if p.getName().startswith(prefix) and p.getName()[len(prefix) :].isdigit()}

    published = {r.version for r in spark.read.schema("version long").parquet(f"{folder}/published").distinct().collect()}
    manifests, stored = there("versions", ""), there("payloads", "stored=")
    known = sorted(published & set(manifests))
    readable = set(known[-max(1, keep) :]) | set(held) & set(known)
    wanted = {r.stored for v in readable for r in spark.read.parquet(str(manifests[v])).select("stored").distinct().collect()}
    gone = [p for v, p in manifests.items() if v < known[-1] and v not in readable] + [p for v, p in stored.items() if v < known[-1] and v not in wanted]
    for path in gone:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return sorted("/".join(str(p).split("/")[-2:]) for p in gone)


def payloads(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """key, payload of all that a manifest lists; folders that it doesn't name are left out by the join."""
    held = spark.read.schema("key long, payload binary, stored long").parquet(f"{folder}/payloads")
    return held.join(manifest.select("key", "stored"), ["key", "stored"]).select("key", "payload")


def admit(archive: DataFrame, records: DataFrame, now_ms: Column, days: int, most: int, width: int = DAY_MS) -> DataFrame:
    """Both: id, started, ended (texts), bytes. New records join the archive if they fit at all; then those beyond the age go, and the oldest until the rest fits.

    A new record whose times can't be read is an error.
    """
    at = lambda c: F.try_to_timestamp(c)
    wrong = at(F.col("started")).isNull() | at(F.col("ended")).isNull()
    checked = F.when(wrong, F.raise_error(F.lit("a record has an invalid timestamp")).cast("string")).otherwise(F.col("started"))
    new = records.withColumn("started", checked).where(F.col("bytes") <= most)
    every = archive.unionByName(new).withColumn("__ms", F.unix_millis(at(F.col("started")))).withColumn("__all", F.lit(0))
    young = every.where(F.col("__ms") >= now_ms - days * DAY_MS)
    return keep_newest_bytes(young, "__all", ["__ms", "id"], "bytes", most, width=width).drop("__ms", "__all")


# What can be amended in a record, and how much of a failure is kept.
AMENDED = ("transcript", "narration", "failure")
FAILURE = 1000


def amend(archive: DataFrame, changes: DataFrame) -> DataFrame:
    """``archive``: id, transcript, opus, voice, error. ``changes``: id, at (their order, unique for a record), kind, text, opus. Adds narration_bytes.

    A transcript (text) takes narration and error away, a narration (opus, its voice as text) the error, a failure (text, cut) the narration; so the last
    transcript and the last change decide. Changes of records that aren't there do nothing, and records without changes stay as they are.
    """
    what = F.struct("kind", "text", "opus")
    last = changes.groupBy("id").agg(F.max_by(what, "at").alias("last"), F.max_by("text", F.when(F.col("kind") == "transcript", F.col("at"))).alias("said"), F.count_if(F.col("kind") == "transcript").alias("n"))
    rows = archive.join(last, "id", "left")
    kind = F.col("last.kind")
    keep = lambda now, of, then: F.when(kind.isNull(), F.col(now)).when(kind == of, then).alias(now)
    amended = rows.select("id", F.when(F.col("n") > 0, F.col("said")).otherwise(F.col("transcript")).alias("transcript"), keep("opus", "narration", F.col("last.opus")), keep("voice", "narration", F.col("last.text")), keep("error", "failure", F.left("last.text", F.lit(FAILURE))))
    return amended.withColumn("narration_bytes", F.coalesce(F.octet_length("opus"), F.lit(0)).cast("long"))


def verified_copy(rows: DataFrame, key: str, path: str) -> DataFrame:
    """Writes a copy where there is none yet and returns it, after every key was found in it as often as in ``rows``."""
    rows.write.mode("errorifexists").parquet(path)
    copy = rows.sparkSession.read.schema(rows.schema).parquet(path)
    signed = rows.select(key, F.lit(1).alias("n")).union(copy.select(key, F.lit(-1).alias("n")))
    if signed.groupBy(key).agg(F.sum("n").alias("n")).where("n <> 0").limit(1).count():
        raise ValueError("the copy doesn't match its source")
    return copy
