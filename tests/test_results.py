from datetime import date

import pytest
from pyspark.sql import functions as F

from fencewatch.operators import results
from fencewatch.operators.feeds import feed_links, item_links
from fencewatch.settings import HTML_SEARCH, RSS_SEARCH
from tests.pages import feed, result_page, result_row


@pytest.fixture(scope="module")
def pages(spark):
    def build(*htmls):
        return spark.createDataFrame([(f"u{i}", h) for i, h in enumerate(htmls)], "url string, html string")

    return build


def test_rows_are_read_inside_their_own_row(pages):
    html = result_page(
        [
            result_row(1, " Dec 11", " $1450", " (HARBOUR)", cat="cars & trucks"),
            result_row(2, " Jan 02", " $10", " (BURNABY)", title="other <b>bike</b>", cat="bikes"),
        ]
    )
    rows = results.result_rows(pages(html), 2012).orderBy("pos").collect()
    first, second = (row.asDict() for row in rows)
    assert first == {
        "url": "u0",
        "pos": 0,
        "link_url": "http://porto.en.x.org/bik/1.html",
        "short_title": "item 1",
        "date_text": " Dec 11",
        "date_posted_real": date(2012, 12, 11),
        "date_posted_parsed": "11 Dec 2012 00:00:00",
        "price": "$1450",
        "sale_area": " (HARBOUR)",
        "category": "cars & trucks",
    }
    assert (second["price"], second["sale_area"], second["category"], second["short_title"]) == (
        "$10",
        " (BURNABY)",
        "bikes",
        "other bike",
    )
    assert second["date_posted_real"] == date(2012, 1, 2)


def test_missing_parts_are_null_and_rows_stay(pages):
    html = result_page(
        [
            result_row(1, date="soon", price="", area=None),
            result_row(2, price=None),
            '<p class="row">bare</p>',
            '<p class="row">never closed <a href="/x">x</a>',
            "<P class='row'><A HREF='/y'>y</A></P>",
            '<p class="rows">no</p>',
        ]
    )
    rows = results.result_rows(pages(html), 2012).orderBy("pos").collect()
    assert len(rows) == 5
    assert rows[0].date_posted_real is None and rows[0].date_posted_parsed is None
    assert rows[0].price == "" and rows[0].sale_area is None
    assert rows[1].price is None
    assert rows[2].link_url is None and rows[2].short_title is None and rows[2].category is None
    assert [row.link_url for row in rows[3:]] == ["/x", "/y"]


def test_year_end_roll_back(pages):
    html = result_page([result_row(1, " Dec 30"), result_row(2, " Jan 02")])
    crawl = F.lit(date(2013, 1, 3))
    summaries = results.summarise_result_pages(pages(html), 2013, crawled_on=crawl)
    rows = summaries.select(F.inline("rows")).orderBy("pos").collect()
    assert [r.date_posted_real for r in rows] == [date(2012, 12, 30), date(2013, 1, 2)]


@pytest.mark.parametrize("rules,limit", [(HTML_SEARCH, 50), (RSS_SEARCH, 25)])
def test_guard(spark, pages, rules, limit):
    counts = [0, 1, limit - 1, limit, limit + 50]
    html = [result_page([result_row(i) for i in range(n)]) for n in counts]
    summaries = results.summarise_result_pages(pages(*html), 2012, rules)
    asked = spark.createDataFrame([(f"u{i}",) for i in range(len(counts) + 1)], "url string")
    asked = asked.unionByName(spark.createDataFrame([(None,)], "url string"))
    guarded = results.guard_results(results.find_result_pages(asked, summaries), rules)
    got = {r.url: r for r in guarded.collect()}
    assert [got[f"u{i}"].status for i in range(6)] == [
        "empty", "ok", "ok", "too_many", "too_many", "page_missing",
    ]
    assert got[None].status == "bad_request"
    assert [got[f"u{i}"].n_rows for i in range(6)] == [*counts, None]
    assert got["u3"].status_title == (
        f"More than {limit} results returned, please be more selective"
    )
    assert got["u3"].status_description == "Error"
    assert got["u0"].status_title == "No results returned, alter your search terms"
    assert got["u0"].status_description == ("" if rules is HTML_SEARCH else "Error")
    expanded = results.expand_results(guarded).groupBy("url").count()
    sizes = {r["url"]: r["count"] for r in expanded.collect()}
    assert sizes == {"u0": 1, "u1": 1, "u2": limit - 1, "u3": 1, "u4": 1, "u5": 1, None: 1}


def test_guarded_pages_lose_their_rows_before_any_shuffle(pages):
    html = result_page([result_row(i) for i in range(60)])
    row = results.summarise_result_pages(pages(html), 2012).first()
    assert row.n_rows == 60 and row.rows is None


def test_no_shuffle_when_splitting(pages):
    plan = results.result_rows(pages(result_page([result_row(1)])), 2012)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text
    # Each row is parsed once: no second copy of the expressions in a pushed filter.
    assert text.count("itempp") == summary_text(pages).count("itempp")


def summary_text(pages):
    summaries = results.summarise_result_pages(pages(""), 2012)
    return summaries._jdf.queryExecution().executedPlan().toString()


def test_page_links(pages):
    links = results.page_links(pages('<a href="/1">one <b>1</b></a><a>none</a><abbr>x</abbr>'))
    rows = links.orderBy("pos").collect()
    assert [(r.pos, r.link_url, r.short_title) for r in rows] == [(0, "/1", "one 1"), (1, None, "none")]


def test_search_url_of_bad_page_is_null(spark):
    asked = spark.createDataFrame(
        [("vancouver", "2", "kona"), ("vancouver", "two", "kona")], "city string, page string, terms string"
    )
    rows = results.with_search_url(asked).orderBy("page").collect()
    assert rows[0].url.endswith("query=kona&srchType=A&s=200")
    assert rows[1].url is None


def test_feed_links(spark):
    feeds = spark.createDataFrame(
        [
            ("a", feed([])),
            ("b", feed(["http://x/1?a=1&amp;b=2", "http://x/2"])),
            ("c", feed(["http://x/3"], quote="'")),
            ("d", "<rdf:RDF><items/></rdf:RDF>"),
            ("e", "not xml at all"),
        ],
        "url string, xml string",
    )
    rows = feed_links(feeds).orderBy("url", "pos").collect()
    assert [(r.url, r.pos, r.link_url) for r in rows] == [
        ("b", 0, "http://x/1?a=1&b=2"),
        ("b", 1, "http://x/2"),
        ("c", 0, "http://x/3"),
    ]


def test_feed_link_is_the_first_attribute(one):
    xml = '<rdf:Seq><rdf:li rdf:resource="http://x/1" other="no"/><x:li b="http://x/2" a="no"/></rdf:Seq>'
    assert one(xml, item_links) == ["http://x/1", "http://x/2"]


def test_paging(spark):
    frame = spark.createDataFrame(
        [("a", i) for i in range(25)] + [("b", i) for i in range(8)], "g string, v int"
    )
    got = results.one_page_of_rows(frame, "g", [F.col("v")], page=1, page_size=10)
    rows = got.orderBy("g", "v").collect()
    assert [(r.g, r.v, r.row_no) for r in rows] == [("a", i, i + 1) for i in range(10, 20)]
    null_group = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    last = results.one_page_of_rows(null_group, "g", [F.col("v").desc()], page=1, page_size=1)
    assert [(r.g, r.v, r.row_no) for r in last.collect()] == [(None, 1, 2)]


def test_over_long_pages_keep_their_rows(spark):
    pages = spark.createDataFrame([("u", result_page([result_row(n) for n in range(120)]))], "url string, html string")
    assert results.result_rows(pages, 2012).count() == 120


def test_bare_attributes_and_other_spellings(spark):
    html = "<html><P Class=row><a title=x href=/y>z</a><span class=itempp>$5</span></P><p class=rows></p></html>"
    row = results.result_rows(spark.createDataFrame([("u", html)], "url string, html string"), 2012).collect()
    assert [(r.link_url, r.short_title, r.price) for r in row] == [("/y", "z", "$5")]
