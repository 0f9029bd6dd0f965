import collections
import json
import re

import pytest
from pyspark.sql import functions as F

from fencewatch.operators import images
from fencewatch.operators.keyed import join_on_text, newest_per_key
from fencewatch.operators.output import image_response_json
from fencewatch.plans.image_lookup import look_up_images
from fencewatch.workload import render
from tests.pages import match_page

HOST = "http://images.craigslist.org/"


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame(
        [
            (HOST + "a", 200, match_page(23, ["http://o/1", "http://o/2"])),
            (HOST + "b", 500, match_page(9, ["http://o/1"])),
            (HOST + "d", 204, "<p>no count</p>"),
            (HOST + "e", 200, match_page(0)),
        ],
        "image_uri string, http_status int, html string",
    )


def test_rows_keep_empty_ids(spark):
    lookups = spark.createDataFrame(
        [("123", "aXKRXKRXKRXKRXKRXKRb"), ("9", ""), ("7", "one.jpg")], "listing_id string, images string"
    )
    rows = images.image_rows(lookups).orderBy("listing_id", "pos").collect()
    assert [(r.listing_id, r.pos, r.image_uri) for r in rows] == [
        ("123", 0, HOST + "a"),
        ("123", 1, HOST),
        ("123", 2, HOST + "b"),
        ("7", 0, HOST + "one.jpg"),
        ("9", 0, HOST),
    ]


def test_match_count(many):
    pages = [match_page(23), "<h2>\n<span>0</span>\n Results</h2>", "<h2>5 Results</h2>", None]
    assert many(pages, images.match_count) == [23, 0, None, None]


def test_lookup(spark, answers):
    lookups = spark.createDataFrame(
        [("1", "XKRXKRXKR".join("abcde")), ("2", "a")], "listing_id string, images string"
    )
    got = {r.listing_id: json.loads(r.json) for r in look_up_images(lookups, answers).collect()}
    counts = [i["tinEyeImageCount"] for i in got["1"][0]["tinEyeImageInfos"]]
    assert counts == [23, 0, 0, 0, 0]
    assert got["2"] == [
        {
            "craigslistInfoId": "2",
            "tinEyeImageInfos": [{"imageURI": HOST + "a", "tinEyeImageCount": 23}],
        }
    ]


def test_newest_answer_counts(spark):
    pages = spark.createDataFrame(
        [("i", 200, match_page(1), 1), ("i", 200, match_page(7), 2)],
        "image_uri string, http_status int, html string, fetched_at int",
    )
    wanted = spark.createDataFrame([("l", 0, "i")], "listing_id string, pos int, image_uri string")
    assert [r.match_count for r in images.count_matches(wanted, pages).collect()] == [7]


def test_long_lists_give_one_answer_and_lose_nothing(spark):
    counted = spark.range(2500).select(
        F.lit("x").alias("listing_id"),
        F.col("id").cast("int").alias("pos"),
        F.col("id").cast("string").alias("image_uri"),
        F.lit(0).alias("match_count"),
    )
    rows = image_response_json(images.nested_image_results(counted)).collect()
    seen = [i["imageURI"] for r in rows for i in json.loads(r.json)[0]["tinEyeImageInfos"]]
    assert len(rows) == 1
    assert seen == [str(i) for i in range(2500)]


def test_locations_and_sharing(spark, answers):
    used = spark.createDataFrame(
        [("l1", 0, HOST + "a"), ("l2", 0, HOST + "a"), ("l2", 1, HOST + "a"), ("l3", 0, HOST + "b")],
        "listing_id string, pos int, image_uri string",
    )
    places = images.match_locations(answers)
    assert sorted((r.image_uri, r.original_url) for r in places.collect()) == [
        (HOST + "a", "http://o/1"),
        (HOST + "a", "http://o/2"),
    ]
    counts = images.adverts_per_original(images.originals_used(used, places))
    assert sorted((r.original_url, r.n_listings) for r in counts.collect()) == [
        ("http://o/1", 2),
        ("http://o/2", 2),
    ]
    shared = images.shared_images(used, places)
    assert sorted((r.listing_id, r.shared_by) for r in shared.collect()) == [("l1", 2), ("l2", 2)]


def test_listing_images(spark):
    listings = spark.createDataFrame(
        [("u", ["a", "b"]), ("v", None)], "link_url string, images array<string>"
    )
    rows = images.listing_images(listings).orderBy("pos").collect()
    assert [(r.listing_id, r.pos, r.image_uri) for r in rows] == [("u", 0, "a"), ("u", 1, "b")]


def test_counts_of_one_and_of_thousands(many):
    pages = ["<h2><span>1</span> Result</h2>", "<h2> <span>1,234,567</span> Results", "<h2><span>x</span> Results"]
    assert many(pages, images.match_count) == [1, 1234567, None]


def test_a_join_by_hash_equals_a_join(spark):
    left = spark.createDataFrame([("http://a/1", 1), ("http://a/2", 2), ("http://a/2", 3), (None, 4)], "url string, n int")
    right = spark.createDataFrame([("http://a/2", "x"), ("http://a/2", "y"), ("http://a/3", "z"), (None, "w")], "url string, v string")
    for how in ("inner", "left"):
        got, wanted = join_on_text(left, right, "url", how), left.join(right, "url", how)
        assert got.columns == wanted.columns
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, wanted.collect()))


def test_newest_rows_are_sorted_by_a_number_first(spark):
    pages = spark.createDataFrame([("http://a/1", 1, "old"), ("http://a/1", 2, "new"), (None, 3, "none")], "url string, fetched_at int, html string")
    newest = newest_per_key(pages, "url", [F.col("fetched_at").desc()])
    assert [r["html"] for r in newest.collect()] == ["new"]
    plan = newest._jdf.queryExecution().optimizedPlan().toString()
    assert "__key_hash" in re.search(r"row_number\(\) windowspecdefinition\((\w+)", plan)[1]


def test_rendered_rows_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    rows = spark.range(1000).coalesce(1)
    assert render.spread(rows, "id").rdd.getNumPartitions() == 1
    monkeypatch.setattr(render, "ROWS_OF_A_TASK", 100)
    dealt = render.spread(rows, "id")
    assert dealt.rdd.getNumPartitions() == 10 and sorted(r["id"] for r in dealt.collect()) == list(range(1000))
