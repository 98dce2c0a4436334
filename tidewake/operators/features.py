"""Features of a sound's frames: medians around each frame, and which frames sound like noise.

Frames carry their index in their key's stream. The stream is cut into stretches of frames, each with the margin that its
windows reach into; so a long stream is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators.signal import middle

NEAR, AROUND = 5, 12  # frames on either side: of a median, and of the deviation of medians
MARGIN = NEAR + AROUND
BELOW_DB, RATIO_DB, STEADY_DB = 3.0, 2.5, 1.5


def candidates(frames: DataFrame, keys: list[str], level: float, ratio: float, stretch: int = 8192) -> DataFrame:
    """``frames``: keys, n, level, ratio. Adds smooth and mad (of the ratio), ahead (whether ``MARGIN`` frames follow) and candidate.

    A candidate is nearly as loud as the template's ``level``, itself and smoothed; its smoothed ratio is near the template's and steady.
    The first and last ``MARGIN`` frames of a stream aren't. Frames are without gaps; what two frames of one index give isn't defined.
    """
    own = F.floor(F.col("n") / stretch)
    places = F.array_distinct(F.array(own, F.floor((F.col("n") - MARGIN) / stretch), F.floor((F.col("n") + MARGIN) / stretch)))
    cut = frames.withColumn("__own", own).withColumn("__at", F.explode(places))
    order = Window.partitionBy(*keys, "__at").orderBy("n")
    near = lambda c, k: F.array_sort(F.collect_list(c).over(order.rowsBetween(-k, k)))
    smoothed = cut.select("*", near("ratio", NEAR).alias("__r"), near("level", NEAR).alias("__l"), F.lead("n", MARGIN).over(order).isNotNull().alias("ahead"))
    smoothed = smoothed.withColumns({"smooth": middle(F.col("__r")), "__level": middle(F.col("__l"))}).drop("__r", "__l")
    around = smoothed.withColumn("__s", near("smooth", AROUND)).withColumn("__m", middle(F.col("__s")))
    steady = around.where("__at = __own").withColumn("mad", middle(F.array_sort(F.transform("__s", lambda x: F.abs(x - F.col("__m"))))))
    loud = (F.col("level") >= level - BELOW_DB) & (F.col("__level") >= level - BELOW_DB)
    like = (F.abs(F.col("smooth") - ratio) <= RATIO_DB) & (F.col("mad") <= STEADY_DB)
    out = steady.withColumn("candidate", (F.col("n") >= MARGIN) & F.col("ahead") & loud & like)
    return out.select(*frames.columns, "smooth", "mad", "ahead", "candidate")


EVERY, HISTORY = 100, 2000  # frames between two templates, and those that one is made of
LEAST, LEAST_LOUD, SPREAD_DB, OFF_DB = 200, 50, 8.0, 2.0


def template(level: np.ndarray, ratio: np.ndarray) -> tuple[float, float, int, int, bool]:
    """ratio, level, n, loud, valid of some frames: the upper quartile of level, and the median ratio of the frames that reach it.

    Valid if there are enough frames, enough of them loud, the levels' quartiles far enough apart, and the loud ones' ratios close (by their median deviation).
    Quartiles are the values at the place rounded down.
    """
    n = len(level)
    low, high = np.sort(level)[[int(0.25 * (n - 1)), int(0.75 * (n - 1))]]
    loud = ratio[level >= high]
    if n < LEAST or len(loud) < LEAST_LOUD:
        return 0.0, float(high), n, len(loud), False
    centre = float(np.median(loud))
    return centre, float(high), n, len(loud), bool(high - low >= SPREAD_DB and np.median(np.abs(loud - centre)) <= OFF_DB)


def templates(frames: DataFrame, key: str, stretch: int = 8192, every: int = EVERY, history: int = HISTORY) -> DataFrame:
    """``frames``: key, n, level, ratio. key, n, ratio, level, frames, loud, valid: the noise template at each ``every``-th frame (from ``LEAST`` - 1 on), over the last ``history``.

    The stream is cut into stretches, each with the frames before it that its templates reach back to, so a long one is many tasks.
    """

    def run(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        n, level, ratio = (table.column(c).to_numpy() for c in ("n", "level", "ratio"))
        first = group[1].as_py() * stretch
        out = []
        for at in n[(n >= max(first, LEAST - 1)) & (n < first + stretch) & (n % every == 0)].tolist():
            a, b = np.searchsorted(n, [at - history, at], side="right")
            out.append((group[0].as_py(), at, *template(level[a:b], ratio[a:b])))
        kinds = (group[0].type, pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [key, "n", "ratio", "level", "frames", "loud", "valid"])

    at = F.col("n").cast("long")
    cut = frames.select(key, at.alias("n"), F.col("level").cast("double"), F.col("ratio").cast("double"), F.explode(F.sequence(F.floor(at / stretch), F.floor((at + history - 1) / stretch))).alias("__at"))
    kind = frames.schema[key].dataType.simpleString()
    return cut.groupBy(key, "__at").applyInArrow(run, f"{key} {kind}, n long, ratio double, level double, frames long, loud long, valid boolean")
