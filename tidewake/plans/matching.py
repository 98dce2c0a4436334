"""Joins: channel plans, metrics, vessel identities, requested ids, successors, intervals; scan choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.operators import preroll, scanning
from tidewake.operators.ordered import with_previous
from tidewake.plans.registry import query
from tidewake.sources.domain import SAMPLES_SQL, samples, table

PLAN_SQL = "plan AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'US' ELSE 'CA' END AS country, concat(lpad(CAST(p_partkey % 90 AS VARCHAR), 2, '0'), CASE WHEN p_size % 3 = 0 THEN 'A' ELSE '' END) AS id, CAST(156000000 + 25000 * (p_partkey % 90) AS BIGINT) AS hz, p_brand AS purpose, p_size % 10 = 0 AS weather FROM part)"


def _plan(spark, sf):
    rank = F.col("p_partkey") % 90
    return table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, "US").otherwise("CA").alias("country"), F.concat(F.lpad(rank.cast("string"), 2, "0"), F.when(F.col("p_size") % 3 == 0, "A").otherwise("")).alias("id"),
        (156_000_000 + 25_000 * rank).cast("long").alias("hz"), F.col("p_brand").alias("purpose"), (F.col("p_size") % 10 == 0).alias("weather"),
    )


@query(
    "channel_plan_merge",
    f"""WITH {PLAN_SQL}, c AS (SELECT id, hz, country, min(purpose) AS purpose FROM plan GROUP BY 1, 2, 3),
 m AS (SELECT id, hz, string_agg(country, '+' ORDER BY country DESC) AS countries, max(CASE WHEN country = 'US' THEN purpose END) AS us, max(CASE WHEN country = 'CA' THEN purpose END) AS ca FROM c GROUP BY 1, 2)
 SELECT id, hz, countries, CASE WHEN us <> ca THEN concat('US: ', us, ' · Canada: ', ca) ELSE coalesce(us, ca) END AS purpose FROM m""",
)
def channel_plan_merge(spark, sf):
    """Both countries' plans by (id, frequency); purposes side by side where they differ."""
    of = lambda c: F.min(F.when(F.col("country") == c, F.col("purpose")))
    merged = _plan(spark, sf).groupBy("id", "hz").agg(of("US").alias("us"), of("CA").alias("ca"))
    both = F.col("us").isNotNull() & F.col("ca").isNotNull()
    purpose = F.when(both & (F.col("us") != F.col("ca")), F.concat(F.lit("US: "), "us", F.lit(" · Canada: "), "ca")).otherwise(F.coalesce("us", "ca"))
    return merged.select("id", "hz", F.when(both, "US+CA").when(F.col("us").isNotNull(), "US").otherwise("CA").alias("countries"), purpose.alias("purpose"))


@query(
    "channel_sort",
    f"""WITH {PLAN_SQL}, d AS (SELECT id, bool_or(weather) AS weather FROM plan GROUP BY id) SELECT id, CAST(weather AS INTEGER) AS weather, row_number() OVER (ORDER BY CAST(weather AS INTEGER), CAST(regexp_extract(id, '^(\\d+)', 1) AS INTEGER), regexp_extract(id, '([A-Z]*)$', 1)) AS place FROM d""",
)
def channel_sort(spark, sf):
    """Weather channels last, then by number and suffix. The plan is a small fixed table, so one task may order it."""
    order = Window.orderBy("weather", F.regexp_extract("id", r"^(\d+)", 1).cast("int"), F.regexp_extract("id", "([A-Z]*)$", 1))
    return _plan(spark, sf).groupBy("id").agg(F.bool_or("weather").cast("int").alias("weather")).withColumn("place", F.row_number().over(order).cast("long"))


@query(
    "metrics_join_dedup",
    f"""WITH {SAMPLES_SQL}, {PLAN_SQL}, f AS (SELECT hz, id, row_number() OVER (PARTITION BY hz ORDER BY id) AS nth FROM plan), m AS (SELECT 156000000 + 25000 * (k % 90) AS hz, start_ms // 86400000 AS day, max(score) AS score FROM samples GROUP BY 1, 2)
 SELECT m.day, m.hz, f.id, m.score, CASE WHEN m.score >= 2 AND nth = 1 THEN 1 ELSE 0 END AS active FROM m JOIN f ON f.hz = m.hz""",
)
def metrics_join_dedup(spark, sf):
    """A day's best score per frequency, for every channel of that frequency; active is only the plan's first."""
    first = F.row_number().over(Window.partitionBy("hz").orderBy("id")) == 1  # a plan's channels of one frequency
    plan = _plan(spark, sf).select("hz", "id", first.alias("first"))
    best = samples(spark, sf).groupBy((156_000_000 + 25_000 * (F.col("k") % 90)).alias("hz"), F.floor(F.col("start_ms") / 86_400_000).alias("day")).agg(F.max("score").alias("score"))
    return best.join(plan, "hz").select("day", "hz", "id", "score", (F.col("first") & (F.col("score") >= 2)).cast("int").alias("active"))


@query(
    "scan_best",
    f"""WITH {SAMPLES_SQL}, c AS (SELECT start_ms // 3600000 AS hour, channel, max(score * CASE WHEN channel = 'view' THEN 1.2 ELSE 1.0 END) AS w FROM samples WHERE channel <> 'error' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY w DESC, channel) AS rn FROM c WHERE w >= 2)
 SELECT hour, channel, round(w, 9) AS weight FROM r WHERE rn = 1""",
)
def scan_best(spark, sf):
    """Each hour's best channel: the calling channel is weighted up, the excluded one left out."""
    weight = F.max(F.col("score") * F.when(F.col("channel") == "view", 1.2).otherwise(1.0)).alias("w")
    rows = samples(spark, sf).where("channel <> 'error'").groupBy(F.floor(F.col("start_ms") / 3_600_000).alias("hour"), "channel").agg(weight).where("w >= 2")
    best = F.row_number().over(Window.partitionBy("hour").orderBy(F.col("w").desc(), "channel"))
    return rows.withColumn("rn", best).where("rn = 1").select("hour", "channel", F.round("w", 9).alias("weight"))


@query(
    "scan_adaptive",
    f"""WITH {SAMPLES_SQL}, h AS (SELECT start_ms // 3600000 AS hour, channel, max(start_ms) FILTER (WHERE k % 3 <> 0) AS visited, max(score) FILTER (WHERE k % 3 <> 0) AS score FROM samples GROUP BY 1, 2),
 n AS (SELECT start_ms // 3600000 AS hour, arg_max(channel, (start_ms, event_id)) AS current FROM samples GROUP BY 1), c AS (SELECT hour, channel, row_number() OVER (PARTITION BY hour ORDER BY channel) - 1 AS place FROM n, (SELECT DISTINCT channel FROM samples) WHERE channel <> current),
 p AS (SELECT hour, channel, place, CASE WHEN visited IS NULL THEN 86400000 - place ELSE greatest(1, (hour + 1) * 3600000 - visited) END * (1 + 0.75 * greatest(0, coalesce(CASE WHEN visited IS NOT NULL THEN score END, 0))) AS priority FROM c LEFT JOIN h USING (hour, channel)),
 r AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY priority DESC, place) AS rn FROM p) SELECT hour, channel, round(priority, 3) AS priority FROM r WHERE rn = 1""",
)
def scan_adaptive(spark, sf):
    """At each hour's end the next channel: not the one that was heard last, and those without a visit first."""
    rows = samples(spark, sf).withColumn("hour", F.floor(F.col("start_ms") / 3_600_000))
    visits = rows.where("k % 3 <> 0").groupBy("hour", "channel").agg(F.max("start_ms").alias("visited"), F.max("score").alias("score"))
    visits = visits.groupBy("hour").agg(F.collect_list(F.struct("channel", "visited", "score")).alias("visits"))  # one row a channel of the plan
    current = rows.groupBy("hour").agg(F.max_by("channel", F.struct("start_ms", "event_id")).alias("current"))
    plan = rows.select("channel").distinct().agg(F.array_sort(F.collect_list("channel")).alias("candidates"))  # one row
    every = current.join(visits, "hour", "left").crossJoin(plan).withColumn("visits", F.coalesce("visits", F.array().cast(visits.schema["visits"].dataType)))
    best = scanning.adaptive_choice(F.col("candidates"), F.col("visits"), (F.col("hour") + 1) * 3_600_000, F.col("current"))
    return every.select("hour", best.alias("b")).where("b.channel is not null").select("hour", "b.channel", F.round("b.priority", 3).alias("priority"))


@query(
    "identity_enrich",
    """SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS mmsi, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_name END, s_name) AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS callsign
 FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_custkey""",
)
def identity_enrich(spark, sf):
    """Messages with the vessel of their own key, else of the fallback key; a message without any stays as it is."""
    mmsi = F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("mmsi")
    ships = table(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("mmsi"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("own"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("callsign"))
    others = table(spark, sf, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("mmsi"), F.col("s_name").alias("other"))
    rows = table(spark, sf, "orders").select("o_orderkey", mmsi).join(ships, "mmsi", "left").join(others, "mmsi", "left")
    return rows.select("o_orderkey", "mmsi", F.coalesce("own", "other").alias("name"), "callsign")


@query(
    "session_validate",
    """WITH l AS (SELECT l_orderkey, l_returnflag, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS before FROM lineitem)
 SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN 1 ELSE 0 END AS same_flag, CASE WHEN bool_and(before IS NULL OR l_shipdate >= before) THEN 1 ELSE 0 END AS ordered, count(*) AS n FROM l GROUP BY 1""",
)
def session_validate(spark, sf):
    """Whether a session's records agree and don't go back in time."""
    before = F.lag("l_shipdate").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate", before.alias("before"))
    same = (F.min("l_returnflag") == F.max("l_returnflag")).cast("int").alias("same_flag")
    ordered = F.bool_and(F.col("before").isNull() | (F.col("l_shipdate") >= F.col("before"))).cast("int").alias("ordered")
    return rows.groupBy("l_orderkey").agg(same, ordered, F.count("*").alias("n"))


@query(
    "ids_semijoin",
    """WITH r AS (SELECT c_custkey, unnest([c_custkey, c_custkey * 2, c_custkey * 3 + 1]) AS asked FROM customer), h AS (SELECT r.c_custkey, count(*) AS asked, count(o.o_orderkey) AS found FROM r LEFT JOIN orders o ON o.o_orderkey = r.asked GROUP BY 1)
 SELECT c_custkey, asked, found, CASE WHEN asked = found THEN 1 ELSE 0 END AS accepted FROM h""",
)
def ids_semijoin(spark, sf):
    """Lists of ids against what is kept: any miss rejects the whole list."""
    c = F.col("c_custkey")
    asked = table(spark, sf, "customer").select(c, F.explode(F.array(c, c * 2, c * 3 + 1)).alias("o_orderkey"))
    kept = table(spark, sf, "orders").select("o_orderkey", F.lit(1).alias("hit"))
    out = asked.join(kept, "o_orderkey", "left").groupBy("c_custkey").agg(F.count("*").alias("asked"), F.count("hit").alias("found"))
    return out.withColumn("accepted", (F.col("asked") == F.col("found")).cast("int"))


@query(
    "interval_trim",
    f"""WITH {SAMPLES_SQL}, t AS (SELECT event_id, channel, greatest(start_ms, (start_ms // 86400000) * 86400000 + 21600000) AS a, least(end_ms, (start_ms // 86400000) * 86400000 + 64800000) AS b FROM samples) SELECT event_id, channel, a AS from_ms, b AS to_ms FROM t WHERE b > a""",
)
def interval_trim(spark, sf):
    """Intervals clipped to their day's window."""
    day = F.floor(F.col("start_ms") / 86_400_000) * 86_400_000
    return samples(spark, sf).select("event_id", "channel", F.greatest("start_ms", day + 21_600_000).alias("from_ms"), F.least("end_ms", day + 64_800_000).alias("to_ms")).where("to_ms > from_ms")


@query(
    "live_overlap",
    f"""WITH {SAMPLES_SQL}, l AS (SELECT channel, start_ms // 3600000 AS hour, min(start_ms) FILTER (WHERE k % 3 <> 0) AS live FROM samples GROUP BY 1, 2), r AS (SELECT s.event_id, s.channel, s.start_ms, least(s.end_ms, coalesce(l.live, s.end_ms)) AS stop, start_ms // 3600000 AS hour FROM samples s JOIN l ON l.channel = s.channel AND l.hour = s.start_ms // 3600000 WHERE k % 3 = 0),
 p AS (SELECT *, greatest(start_ms, coalesce(max(stop) OVER (PARTITION BY channel, hour ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_ms)) AS a FROM r) SELECT event_id, channel, a AS from_ms, stop AS to_ms FROM p WHERE stop > a""",
)
def live_overlap(spark, sf):
    """Recovered pieces, cut at the first live one of their hour and at the end of those before."""
    rows = samples(spark, sf).withColumn("hour", F.floor(F.col("start_ms") / 3_600_000))
    live = rows.groupBy("channel", "hour").agg(F.min(F.when(F.col("k") % 3 != 0, F.col("start_ms"))).alias("live"))
    late = rows.where("k % 3 = 0").join(live, ["channel", "hour"]).withColumn("to_ms", F.least("end_ms", F.coalesce("live", "end_ms")))
    before = F.max("to_ms").over(Window.partitionBy("channel", "hour").orderBy("start_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return late.withColumn("from_ms", F.greatest("start_ms", F.coalesce(before, "start_ms"))).where("to_ms > from_ms").select("event_id", "channel", "from_ms", "to_ms")


@query(
    "cursor_successor",
    f"""WITH {SAMPLES_SQL}, n AS (SELECT event_id, slot, channel, lead(event_id) OVER w AS next_id, lead(channel) OVER w AS next_channel FROM samples WINDOW w AS (PARTITION BY slot ORDER BY start_ms, event_id))
 SELECT event_id, slot, next_id, CASE WHEN next_id IS NULL THEN 'edge' WHEN next_channel <> channel THEN 'channel-change' ELSE 'next' END AS step FROM n""",
)
def cursor_successor(spark, sf):
    """Where a cursor goes from each segment. Both slots are cut by days, so that neither fills one task."""
    rows, parts = samples(spark, sf), []
    for slot in ("A", "B"):
        turned = rows.where(F.col("slot") == slot).withColumn("turn", -F.col("start_ms")).withColumn("id_turn", -F.col("event_id"))
        parts.append(with_previous(turned, ["turn", "id_turn"], ["event_id", "channel"], 86_400_000))
    out = parts[0].unionByName(parts[1])
    step = F.when(F.col("event_id_prev").isNull(), "edge").when(F.col("channel_prev") != F.col("channel"), "channel-change").otherwise("next")
    return out.select("event_id", "slot", F.col("event_id_prev").alias("next_id"), step.alias("step"))


@query(
    "contiguous_prefix",
    f"""WITH {SAMPLES_SQL}, d AS (SELECT *, start_ms // 86400000 AS day FROM samples), b AS (SELECT *, CASE WHEN channel <> lag(channel) OVER (PARTITION BY slot, day ORDER BY start_ms, event_id) THEN 1 ELSE 0 END AS brk FROM d),
 s AS (SELECT *, sum(brk) OVER (PARTITION BY slot, day ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS part FROM b) SELECT slot, day, min(channel) AS channel, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM s WHERE part = 0 GROUP BY 1, 2""",
)
def contiguous_prefix(spark, sf):
    """Each day's first segments of a slot, up to the first change of channel."""
    order = Window.partitionBy("slot", "day").orderBy("start_ms", "event_id")
    rows = samples(spark, sf).withColumn("day", F.floor(F.col("start_ms") / 86_400_000))
    brk = F.coalesce((F.col("channel") != F.lag("channel").over(order)).cast("long"), F.lit(0))
    first = rows.withColumn("brk", brk).withColumn("part", F.sum("brk").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("part = 0")
    return first.groupBy("slot", "day").agg(F.min("channel").alias("channel"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(
    "frequency_map",
    f"""WITH {SAMPLES_SQL}, w AS (SELECT max(start_ms) - 7 * 86400000 AS lo FROM samples), a AS (SELECT CASE WHEN k % 20 <> 0 THEN 156000000 + 25000 * (k % 90) END AS hz, count(*) AS clips, max(score) AS score FROM samples, w WHERE end_ms >= lo GROUP BY 1),
 r AS (SELECT 156000000 + 25000 * n_nationkey AS hz FROM nation) SELECT hz, clips, score, 'activity' AS kind FROM a UNION ALL SELECT CAST(hz AS BIGINT), 0, NULL, 'slot' FROM r WHERE hz NOT IN (SELECT hz FROM a WHERE hz IS NOT NULL)""",
)
def frequency_map(spark, sf):
    """The last week's activity by frequency, and the planned frequencies without any."""
    rows = samples(spark, sf)
    lo = rows.agg((F.max("start_ms") - 7 * 86_400_000).alias("lo"))
    recent = rows.join(F.broadcast(lo), F.col("end_ms") >= F.col("lo"))
    seen = recent.groupBy(F.when(F.col("k") % 20 != 0, 156_000_000 + 25_000 * (F.col("k") % 90)).alias("hz")).agg(F.count("*").alias("clips"), F.max("score").alias("score")).withColumn("kind", F.lit("activity"))
    planned = table(spark, sf, "nation").select((156_000_000 + 25_000 * F.col("n_nationkey")).cast("long").alias("hz"))
    quiet = planned.join(seen.select("hz"), "hz", "left_anti").select("hz", F.lit(0).cast("long").alias("clips"), F.lit(None).cast("double").alias("score"), F.lit("slot").alias("kind"))
    return seen.unionByName(quiet)


#: Piece by piece: live ones from the last live end on, recovered ones up to the first live piece and from the last end on.
PRE_ROLL_SQL = f"""WITH RECURSIVE {SAMPLES_SQL}, p AS (SELECT user_id AS receiver, start_ms // 864000000 AS call, event_id AS id, start_ms // 10000 AS at_ms, 100 * (k + 1) AS dur_ms, k % 3 = 0 AND start_ms // 10000 % 86400 < 40000 AS rec FROM samples),
 f AS (SELECT *, min(CASE WHEN NOT rec THEN at_ms END) OVER (PARTITION BY receiver, call) AS f, row_number() OVER (PARTITION BY receiver, call ORDER BY at_ms, rec DESC, id) AS rn FROM p),
 w AS (SELECT DISTINCT receiver, call, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS z, CAST(0 AS BIGINT) AS skipped, CAST(-1 AS BIGINT) AS ended, CAST(-1 AS BIGINT) AS live_end FROM p
 UNION ALL SELECT receiver, call, rn, id, a, z, CASE WHEN rec THEN a - at_ms ELSE 0 END, CASE WHEN rec AND z <= a THEN ended ELSE greatest(ended, z) END, CASE WHEN rec THEN live_end ELSE z END
  FROM (SELECT *, CASE WHEN rec THEN least(at_ms + dur_ms, coalesce(f, at_ms + dur_ms)) ELSE greatest(at_ms, live_end) + dur_ms END AS z FROM (SELECT w.receiver, w.call, f.rn, f.id, f.rec, f.at_ms, f.dur_ms, f.f, w.ended, w.live_end, CASE WHEN f.rec THEN greatest(f.at_ms, w.ended) ELSE greatest(f.at_ms, w.live_end) END AS a FROM w JOIN f ON f.receiver = w.receiver AND f.call = w.call AND f.rn = w.rn + 1))),
 h AS (SELECT *, sum(z - a) OVER v AS held, count(*) OVER v AS nth FROM w WHERE rn > 0 AND a < z WINDOW v AS (PARTITION BY receiver, call ORDER BY a DESC, z DESC, id DESC ROWS UNBOUNDED PRECEDING))
 SELECT receiver, call, id AS event_id, a AS from_ms, z AS to_ms, skipped AS skipped_ms FROM h WHERE held <= 20000 OR nth = 1"""


@query("pre_roll_merge", PRE_ROLL_SQL)
def pre_roll_merge(spark, sf):
    """Each call's buffered pieces, live and recovered, timed anew so that they follow each other; the newest 20 s of them."""
    at = F.floor(F.col("start_ms") / 10_000)
    rows = samples(spark, sf).select(F.col("user_id").alias("receiver"), F.floor(F.col("start_ms") / 864_000_000).alias("call"), F.col("event_id").alias("id"), at.alias("at_ms"), (100 * (F.col("k") + 1)).alias("dur_ms"), ((F.col("k") % 3 == 0) & (at % 86_400 < 40_000)).alias("recovered"))
    return preroll.merged(rows, ["receiver", "call"], 20_000).select("receiver", "call", F.col("id").alias("event_id"), "from_ms", "to_ms", "skipped_ms")
