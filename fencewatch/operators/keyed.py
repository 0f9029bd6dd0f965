"""Joins and per-key choices that stay balanced when one key holds much of the data.

Every function here makes a side with one row per key. Such a side comes out of a shuffle on
its key, and Spark would use that same shuffle for a later join; adaptive execution only splits
a skewed join partition when the join has a shuffle of its own on both sides. The group key is
therefore widened by a hash of itself: same groups, but a partitioning that the join cannot take
over, so a hot key on the other side is split at run time. Duplicates of a hot key are reduced
inside each map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fencewatch.sources.scratch import written

_KEY_HASH = "__key_hash"
_OTHER_KEY = "__other_key"
_PLACE = "__place"
_PART = "__part"
_RANK = "__rank"
#: Rows that one task sorts or groups, where a caller knows their number.
ROWS_OF_A_TASK = 200_000


def dealt(rows: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """The same rows, in as many parts as ``n_rows`` asks for; rows of the same keys stay together.

    Adaptive execution joins parts up to a size as they are stored, and addresses take some twenty times that in the
    memory of a task. Few rows are left to it. For keys that are not hot: a part is not split any further.
    """
    parts = -(-n_rows // ROWS_OF_A_TASK)
    return rows.repartition(parts, *keys) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows


def newest_per_key(df: DataFrame, key: str, newest_first: Sequence[Column]) -> DataFrame:
    """One row per non-null key: the first in the given order, ties settled by content."""
    known = df.where(F.col(key).isNotNull()).withColumn(_KEY_HASH, F.xxhash64(key))
    order = [*newest_first, F.xxhash64(*df.columns)]
    # The hash first: rows are then sorted by a number, where addresses would be compared beyond their common beginning.
    window = Window.partitionBy(_KEY_HASH, key).orderBy(*order)
    ranked = known.withColumn(_RANK, F.row_number().over(window))
    return ranked.where(F.col(_RANK) == 1).drop(_RANK, _KEY_HASH)


def aggregate_per_key(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Group on keys (NULL keys left out) for joining the result back to its own rows."""
    known = df.dropna(subset=list(keys))
    grouped = known.groupBy(*keys, F.xxhash64(*keys).alias(_KEY_HASH)).agg(*aggregates)
    return grouped.drop(_KEY_HASH)


def join_on_text(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a text such as an address, by a hash of it first: as ``left.join(right, key, how)``.

    Addresses begin alike, so a sort by them compares most of each pair; a hash tells them apart at once. The hash
    is not the one of the functions above, so the join does not take over their shuffles.
    """

    def hashed(name: str) -> Column:
        return F.xxhash64(F.lit("join"), F.col(name))

    # Compared as expressions: the hash is worked out where it is used and not moved with the rows.
    same = (hashed(key) == hashed(_OTHER_KEY)) & (F.col(key) == F.col(_OTHER_KEY))
    joined = left.join(right.withColumnRenamed(key, _OTHER_KEY), same, how)
    return joined.select(key, *[name for df in (left, right) for name in df.columns if name != key])


def attach_aggregates(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Give every row the aggregates of its group, without gathering any group in one task.

    A window partitioned by the keys would give the same values but holds a whole group in one
    task; this is a partial aggregate and a join that can be split. The rows are read twice, so
    costly ones should be a stored table (see ``sources.scratch.written``).
    """
    return df.join(aggregate_per_key(df, keys, *aggregates), list(keys), "left")


def numbered_rows(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """Add each row's number within its group, from 1 in the given total order.

    Rows are range-sorted on group and order, and written. Counting the rows of every group in each
    sorted part gives the number at which the part starts, so no group is ever in one task: the only
    window is over one row per group and part.
    """
    keys = [F.col(group) for group in groups]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = written(ranged.withColumn(_PLACE, F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn(_PART, F.shiftright(_PLACE, 33))
    counts = placed.groupBy(*groups, _PART).agg(
        F.count("*").alias("__rows"), F.min(_PLACE).alias("__first")
    )
    before = Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(group).alias(f"__{group}") for group in groups],
        F.col(_PART).alias("__at"),
        (F.col("__first") - F.coalesce(F.sum("__rows").over(before), F.lit(0))).alias("__start"),
    )
    same = F.col(_PART) == F.col("__at")
    for group in groups:
        same &= F.col(group).eqNullSafe(F.col(f"__{group}"))
    number = (F.col(_PLACE) - F.col("__start") + 1).cast("int").alias(name)
    return placed.join(starts, same).select(*df.columns, number)
