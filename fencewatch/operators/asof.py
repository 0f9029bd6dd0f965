"""As-of join: the first event of the same key on a day or after it.

Both sides become one table, sorted by key and day over all tasks, so that a hot key is spread by its days. Within
a part of it the next event is carried back over the rows before it; where a part ends before the next event comes, it
is the first one of the same key in a later part. Only those firsts, one for each key and part, are
looked through by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fencewatch.sources.scratch import written

_ROWS = Window.unboundedFollowing


def next_event(
    left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, right_id: str
) -> DataFrame:
    """Rows of ``left`` with ``(right_day, right_id)`` of the first row of ``right`` with the same key, that day or later.

    Equal days go to the smaller id. Both are NULL where there is none, or where the key or the day of the left
    row is NULL. Rows of ``left`` stay as often as they occur; names must differ but for the key.
    """
    kept = F.struct(*[F.col(c) for c in left.columns])
    event = F.struct(F.col(right_day), F.col(right_id))
    asked = left.select(F.col(key).alias("__key"), F.col(left_day).alias("__day"), F.lit(0).alias("__side"), kept.alias("__row"))
    events = right.where(F.col(key).isNotNull() & F.col(right_day).isNotNull()).select(
        F.col(key).alias("__key"), F.col(right_day).alias("__day"), F.lit(1).alias("__side"), event.alias("__event")
    )
    # A row of the left side comes before the events of its own day, and these go by their id over all parts.
    order = ["__key", "__day", "__side", "__event"]
    both = asked.unionByName(events, allowMissingColumns=True)
    ranged = both.repartitionByRange(*order, F.xxhash64("__row")).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("__part", F.shiftright(F.monotonically_increasing_id(), 33)), "as-of")

    after = Window.partitionBy("__key", "__part").orderBy("__day", "__side").rowsBetween(0, _ROWS)
    carried = placed.withColumn("__next", F.min("__event").over(after)).where("__side = 0")
    firsts = placed.where("__side = 1").groupBy("__key", "__part").agg(F.min("__event").alias("__first"))
    # Every part that a key has rows in, with the first event of the parts behind it.
    parts = placed.select("__key", "__part").distinct().join(firsts, ["__key", "__part"], "left")
    behind = Window.partitionBy("__key").orderBy("__part").rowsBetween(1, _ROWS)
    later = parts.withColumn("__later", F.min("__first").over(behind)).where(F.col("__later").isNotNull())
    later = written(later.select("__key", "__part", "__later"), "as-of-parts")
    found = carried.join(later, ["__key", "__part"], "left").withColumn(
        "__found", F.when(F.col("__key").isNotNull() & F.col("__day").isNotNull(), F.coalesce("__next", "__later"))
    )
    return found.select("__row.*", F.col(f"__found.{right_day}").alias(right_day), F.col(f"__found.{right_id}").alias(right_id))


def first_adverts(thefts: DataFrame, adverts: DataFrame, key: str) -> DataFrame:
    """``thefts`` with ``(posted, listing_id, delay_days)`` of the first advert since.

    ``thefts(key, stolen_on, ...)``, ``adverts(key, posted, listing_id)``: which adverts could be the item is
    settled before, by the register match for example.
    """
    found = next_event(thefts, adverts, key, "stolen_on", "posted", "listing_id")
    return found.withColumn("delay_days", F.datediff("posted", "stolen_on"))
