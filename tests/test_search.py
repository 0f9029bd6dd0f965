import json

from pyspark.sql import functions as F

from fencewatch.operators.output import response_json, wire_json
from fencewatch.plans.search import in_request_order, search_html, search_rss
from fencewatch.settings import LISTING_WIRE_NAMES
from fencewatch.sources.sinks import write_answers, write_listings_json
from tests.pages import detail_page, feed, result_page, result_row

BASE = "http://vancouver.en.craigslist.ca/search/sss?query={}&srchType=A{}&s=0"
LINK = "http://porto.en.x.org/bik/{}.html"


def asked(spark, *terms):
    return spark.createDataFrame(
        [(t, "vancouver", "0", t) for t in terms] + [("bad", "vancouver", "x", "bad")],
        "request_id string, city string, page string, terms string",
    )


def details(spark, numbers):
    return spark.createDataFrame(
        [(LINK.format(n), detail_page(f"title {n}", images=["i"])) for n in numbers],
        "url string, html string",
    )


def html_search(spark):
    pages = spark.createDataFrame(
        [
            (BASE.format("two", ""), result_page([result_row(2, price=" $5"), result_row(1)])),
            (BASE.format("none", ""), result_page([])),
            (BASE.format("lots", ""), result_page([result_row(i) for i in range(50)])),
        ],
        "url string, html string",
    )
    requests = asked(spark, "two", "none", "lots", "gone")
    return search_html(requests, pages, details(spark, [1]), 2012)


def test_html_search(spark):
    rows = in_request_order(html_search(spark)).collect()
    got = {(r.request_id, r.pos): r for r in rows}
    assert set(got) == {
        ("two", 0), ("two", 1), ("none", None), ("lots", None), ("gone", None), ("bad", None),
    }
    assert got["two", 0].price == "$5" and got["two", 0].parse_status == "detail_missing"
    assert got["two", 1].title == "title 1" and got["two", 1].dodgy_score == 1000 - 50 - 3
    assert got["lots", None].title == "More than 50 results returned, please be more selective"
    assert (got["lots", None].description, got["lots", None].dodgy_score) == ("Error", 0)
    assert got["none", None].title == "No results returned, alter your search terms"
    assert got["none", None].description == ""
    assert got["gone", None].status == "page_missing" and got["bad", None].status == "bad_request"
    assert [r.pos for r in rows if r.request_id == "two"] == [0, 1]


def test_unique_pages_give_the_same_listings_with_fewer_shuffles(spark):
    pages = spark.createDataFrame(
        [(BASE.format("two", ""), result_page([result_row(2), result_row(1)]))],
        "url string, html string",
    )
    plain = search_html(asked(spark, "two"), pages, details(spark, [1]), 2012)
    unique = search_html(asked(spark, "two"), pages, details(spark, [1]), 2012, unique_pages=True)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, unique.collect()))
    assert "Window" not in unique._jdf.queryExecution().executedPlan().toString()


def test_wire_form(spark):
    listings = html_search(spark)
    rows = {(r.request_id, r.pos): r.json for r in wire_json(listings, "request_id", "pos").collect()}
    full = json.loads(rows["two", 1])
    assert list(full) == list(LISTING_WIRE_NAMES.values())
    assert full["decriptionHTML"] == "some textimgList = [\"i\"];" and full["images"] == ["i"]
    status = json.loads(rows["lots", None])
    assert status["title"].startswith("More than 50") and status["images"] is None
    assert list(status) == list(LISTING_WIRE_NAMES.values())
    answers = {r.request_id: json.loads(r.json) for r in response_json(listings).collect()}
    assert [listing["shortTitle"] for listing in answers["two"]] == ["item 2", "item 1"]
    assert len(answers["none"]) == 1


def test_sinks(spark, tmp_path):
    listings = html_search(spark)
    write_listings_json(listings, str(tmp_path / "listings"))
    lines = spark.read.text(str(tmp_path / "listings"))
    assert lines.count() == 6
    assert list(json.loads(lines.first()[0])) == list(LISTING_WIRE_NAMES.values())
    write_answers(response_json(listings), str(tmp_path / "answers"))
    assert spark.read.text(str(tmp_path / "answers")).count() == 5


def test_rss_search(spark):
    feeds = spark.createDataFrame(
        [
            (BASE.format("two", "&format=rss"), feed([LINK.format(1), LINK.format(9)])),
            (BASE.format("none", "&format=rss"), feed([])),
            (BASE.format("lots", "&format=rss"), feed([LINK.format(i) for i in range(25)])),
            (BASE.format("most", "&format=rss"), feed([LINK.format(i) for i in range(24)])),
        ],
        "url string, xml string",
    )
    requests = asked(spark, "two", "none", "lots", "most")
    listings = search_rss(requests, feeds, details(spark, [1]))
    got = {(r.request_id, r.pos): r for r in listings.where("request_id <> 'most'").collect()}
    assert got["two", 0].title == "title 1" and got["two", 0].price is None
    assert got["two", 1].parse_status == "detail_missing"
    assert got["none", None].description == "Error"
    assert got["lots", None].title == "More than 25 results returned, please be more selective"
    assert listings.where("request_id = 'most'").count() == 24
    assert wire_json(listings, "request_id").count() == 29


def test_same_page_for_many_requests(spark):
    pages = spark.createDataFrame(
        [(BASE.format("q", ""), result_page([result_row(1)]))] * 2, "url string, html string"
    )
    requests = spark.createDataFrame(
        [(f"r{i}", "vancouver", "0", "q") for i in range(3)],
        "request_id string, city string, page string, terms string",
    )
    rows = search_html(requests, pages, details(spark, [1, 1]), 2012).collect()
    assert sorted(r.request_id for r in rows) == ["r0", "r1", "r2"]


def test_only_extracted_fields_are_shuffled(spark):
    plan = html_search(spark)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert not ("Exchange" in line and "html" in line)
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_stolen_date_filter(spark):
    from fencewatch.operators.signals import posted_after

    listings = html_search(spark).withColumn("stolen_date", F.lit("2012-12-11").cast("date"))
    listed = F.col("status") == "ok"
    assert posted_after(listings).where(listed).count() == 2
    assert posted_after(listings).where(~listed).count() == listings.where(~listed).count()
    later = F.lit("2012-12-12").cast("date")
    assert posted_after(listings, later).where(listed).count() == 0
    assert posted_after(listings, later, keep_undated=True).count() == 4
