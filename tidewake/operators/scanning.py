"""Which channel a scan turns to next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSEEN_MS = 86_400_000  #: how long a channel that wasn't visited yet counts as waiting, less its place among the candidates


def adaptive_choice(candidates: Column, visits: Column, now: Column, current: Column) -> Column:
    """channel, priority: the candidate (of an array in plan order) that waits longest, weighted by its activity; the first of equals, null without candidates.

    ``visits``: array of (channel, visited, score), a channel once. The current channel isn't a candidate unless it is the only one.
    """
    left = F.filter(candidates, lambda c: (F.size(candidates) == 1) | ~c.eqNullSafe(current))

    def judged(c, place):
        seen = F.get(F.filter(visits, lambda v: v["channel"] == c), F.lit(0))
        waits = F.when(seen["visited"].isNotNull(), F.greatest(F.lit(1), now - seen["visited"])).otherwise(UNSEEN_MS - place.cast("long"))
        return F.struct((waits * (1 + 0.75 * F.greatest(F.lit(0.0), F.coalesce(seen["score"], F.lit(0.0))))).alias("priority"), (-place).alias("place"), c.alias("channel"))

    best = F.array_max(F.transform(left, judged))
    return F.struct(best["channel"].alias("channel"), best["priority"].alias("priority"))
