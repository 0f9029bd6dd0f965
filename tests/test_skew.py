"""A third of all rows on one key: the join has to be split, and nothing may be lost."""

import pytest
from pyspark.sql import functions as F

from fencewatch.operators.details import DETAIL_COLUMNS, join_details
from fencewatch.operators.keyed import attach_aggregates, newest_per_key

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    "spark.sql.shuffle.partitions": "20",
}
ROWS = 60_000


@pytest.fixture()
def small_thresholds(spark):
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def skewed(spark):
    third = F.col("id") % 3
    key = F.when(third == 0, "hot").when(third == 1, F.concat(F.lit("k"), (F.col("id") % 1000).cast("string")))
    return spark.range(0, ROWS, 1, 16).select(
        key.alias("link_url"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("payload")
    )


def final_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_detail_join_is_split(spark, small_thresholds):
    fields = {
        "title": F.col("link_url"),
        "images": F.lit(None).cast("array<string>"),
        "dodgy_score": F.lit(1),
    }
    keys = skewed(spark).select("link_url")
    snapshots = keys.select(
        "link_url", *[fields.get(n, F.lit("x")).alias(n) for n in DETAIL_COLUMNS]
    )
    details = newest_per_key(snapshots, "link_url", [])
    joined = join_details(skewed(spark), details)
    rows = joined.groupBy().agg(
        F.count("*"), F.count_distinct("id"), F.sum((F.col("title") == F.col("link_url")).cast("int"))
    )
    assert tuple(rows.first()) == (ROWS, ROWS, ROWS * 2 // 3)
    joined.write.format("noop").mode("overwrite").save()
    joined.collect()
    assert "skew=true" in final_plan(joined)
    assert "WindowGroupLimit" in final_plan(joined)


def test_attached_aggregates_are_split(spark, small_thresholds):
    frame = attach_aggregates(skewed(spark), ["link_url"], F.count("*").alias("n"))
    got = {r.link_url: (r.c, r.n) for r in frame.groupBy("link_url", "n").agg(F.count("*").alias("c")).collect()}
    assert got["hot"] == (ROWS // 3, ROWS // 3)
    assert got[None] == (ROWS // 3, None)
    assert all(c == n for key, (c, n) in got.items() if key is not None)
    frame.collect()
    assert "skew=true" in final_plan(frame)
