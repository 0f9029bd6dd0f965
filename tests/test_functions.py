from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fencewatch.functions import advert, html, score, tables, web
from fencewatch.settings import HTML_SEARCH, RSS_SEARCH, WHITESPACE, PhoneRule, Selector


def found(page, selector):
    return html.text_of(html.balanced(html.element(page, selector), page, selector))


def test_inner_text_keeps_script_text_and_entities(many):
    texts = [
        "<section>a <b>b</b>\n</section>",
        "<div>x<script>if (a<b) { t = '<p>'; }</script>y</div>",
        "<p>fish &amp; chips<!-- a > b --></p>",
        "",
        None,
    ]
    assert many(texts, html.inner_text) == [
        "a b\n",
        "xif (a<b) { t = '<p>'; }y",
        "fish &amp; chips",
        "",
        None,
    ]


def test_text_of_element(many):
    texts = [
        '<h2 class="postingtitle">2008 Kona - $1 (X)</h2><h2>second</h2>',
        "<H2>upper</H2>",
        "<h2></h2>",
        "<h22>no</h22>",
        "<h2>never closed",
    ]
    got = many(texts, lambda t: found(t, Selector("h2")))
    assert got == ["2008 Kona - $1 (X)", "upper", "", None, "never closed"]


def test_class_is_matched_exactly(many):
    texts = [
        '<section id="x" class="userbody">in</section>',
        "<section class='userbody'>in</section>",
        '<section class="userbody2">out</section>',
        '<section data-class="userbody">out</section>',
    ]
    body = Selector("section", "userbody", nests=True)
    assert many(texts, lambda t: found(t, body)) == ["in", "in", None, None]


def test_nested_elements_are_balanced(many):
    body = Selector("section", "userbody", nests=True)
    texts = [
        '<section class="userbody">a<section id="p">b</section>c</section>d<section>e</section>',
        '<section>z</section><section class="userbody">a<section>b<section>c</section></section>d'
        "</section>after",
        '<SECTION class="userbody">a<SECTION>b</SECTION>c</SECTION>d',
        '<section class="userbody">a<section>b</section>c',
    ]
    assert many(texts, lambda t: found(t, body)) == ["abc", "abcd", "abc", "abc"]


def test_attribute_of(many):
    texts = [
        '<a href="/x?a=1&amp;b=2" class="y">t</a>',
        "<a class='q' href='/y'>t</a>",
        "<a>no</a>",
        '<a href="">e</a>',
        '<a data-href="no">t</a>',
        """<a href="it's">t</a>""",
    ]
    got = many(texts, lambda t: html.attribute_of(t, "href"))
    assert got == ["/x?a=1&amp;b=2", "/y", None, "", None, "it's"]


def test_whitespace_count(many):
    texts = ["", "a b", " 　\t\r\n x", WHITESPACE, None, "a​b", "\U0001f600 \U0001f600"]
    assert many(texts, advert.whitespace_count) == [0, 1, 6, len(WHITESPACE), None, 0, 1]


def test_description_keeps_carriage_return(one):
    assert one("a\tb\nc\rd", advert.description) == "abc\rd"


def test_image_list(many):
    texts = [
        'var imgList = ["u1","u2"]; x[0]',
        "imgList = []",
        'imgList = ["a", "b"]',
        "imgList = [\n\"a\",\r\n\"b\"\n]",
        "nothing here [a]",
        "imgList = none",
        "imgList = ] then [a]",
        "[x] imgList = [y]",
        None,
    ]
    assert many(texts, lambda t: advert.image_list(advert.image_script(t))) == [
        ["u1", "u2"],
        [""],
        ["a", " b"],
        ["a", "b"],
        None,
        None,
        None,
        ["y"],
        None,
    ]


def test_phone_number(many):
    texts = [
        "call 604-555-1234 now",
        "call 604) 555-1234 now",
        "604-555-1234",
        "call 708 555 1234",
        "604 first, then 708 555 1234",
        "x 604-5",
        "708 555 1234 x 604-555-9999",
        "nothing",
        "",
        None,
        "x 604-555-١٢٣٤",
        "x 604-\U0001f600\U0001f60055-1234",
        "x 604-\U0001d7ce55-12345",
    ]
    assert many(texts, advert.phone_number) == [
        "6045551234",
        "604555123",
        "12345678",
        "7085551234",
        "7085551234",
        "6045",
        "6045559999",
        "12345678",
        "12345678",
        None,
        "604555١٢٣٤",
        "604551",
        "60455123",
    ]


def test_strict_phone_number(many):
    strict = PhoneRule(strict=True)
    texts = ["604-555-1234", "x (604) 555-1234", "part no 160455512345", "none", None]
    assert many(texts, lambda t: advert.phone_number(t, strict)) == [
        "6045551234",
        "6045551234",
        "12345678",
        "12345678",
        None,
    ]


def test_posted_on(many):
    texts = [" Dec 11", " Dec 11 2012", "Dec 11", " Dec 1", " Foo 11", "", None, " Feb 29", " Feb 30"]
    got = many(texts, lambda t: advert.posted_on(t, 2012))
    assert got == [
        date(2012, 12, 11),
        date(2012, 12, 11),
        None,
        None,
        None,
        None,
        None,
        date(2012, 2, 29),
        None,
    ]
    assert many([" Feb 29"], lambda t: advert.posted_on(t, 2013)) == [None]
    shown = many([" Dec 11"], lambda t: advert.posted_text(advert.posted_on(t, 2012)))
    assert shown == ["11 Dec 2012 00:00:00"]


def test_posted_on_rolls_back_over_new_year(many):
    crawl = F.lit(date(2013, 1, 3))
    got = many([" Dec 30", " Jan 02"], lambda t: advert.posted_on(t, 2013, crawl))
    assert got == [date(2012, 12, 30), date(2013, 1, 2)]


@pytest.mark.parametrize("zone", ["UTC", "America/Vancouver", "Asia/Tokyo", "America/Sao_Paulo"])
def test_posted_on_is_the_day_as_written_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        days = [(date(2012, 1, 1) + timedelta(days=n)) for n in range(366)]
        frame = spark.createDataFrame([(d, d.strftime(" %b %d")) for d in days], "d date, t string")
        day = advert.posted_on(F.col("t"), 2012)
        rows = frame.select("d", day.alias("on"), advert.posted_text(day).alias("text")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r["on"] for r in rows] == days
    assert [r["text"] for r in rows] == [d.strftime("%d %b %Y 00:00:00") for d in days]


def test_price_amount(many):
    from decimal import Decimal

    texts = ["$1450", "$1,200.50", "free", "", None]
    assert many(texts, advert.price_amount) == [
        Decimal("1450.00"),
        Decimal("1200.50"),
        None,
        None,
        None,
    ]


def test_scores(spark):
    frame = spark.createDataFrame(
        [(1, None, 0), (2, [""], 10), (3, ["a"] * 10, 500), (4, ["a"] * 11, 501)],
        "i int, images array<string>, w int",
    )
    rows = frame.select(
        "i",
        score.image_points(F.col("images")).alias("ip"),
        score.text_points(F.col("w")).alias("tp"),
        score.dodgy_score(F.col("images"), F.col("w")).alias("s"),
        score.dodgy_description(F.col("images"), F.col("w")).alias("d"),
    ).orderBy("i").collect()
    assert [(r.ip, r.tp, r.s) for r in rows] == [
        (500, 500, 1000),
        (450, 490, 940),
        (0, 0, 0),
        (-50, -1, -51),
    ]
    assert rows[0].d == (
        "No images at all mean a score of 500\nDescription is 0 words long so score of 500"
    )
    assert rows[3].d == (
        "11 images mean a score of -50\nDescription is 501 words long so score of -1"
    )


def test_url_param(many):
    urls = [
        "http://h/p?q=a+b%20c#x",
        "http://h/p?x=1&q=",
        "http://h/p?x=1",
        "http://h/p?q=%zz",
        "http://h/p#?q=frag",
        None,
    ]
    got = many(urls, lambda u: web.url_param(u, "q"))
    assert got == ["a b c", "", "", "", "frag", ""]


def test_search_url(spark):
    frame = spark.createDataFrame([("vancouver", "kona bike", 2)], "c string, t string, p int")
    got = frame.select(
        web.search_url(F.col("c"), F.col("t"), F.col("p"), HTML_SEARCH).alias("h"),
        web.search_url(F.col("c"), F.col("t"), F.col("p"), RSS_SEARCH).alias("r"),
    ).first()
    base = "http://vancouver.en.craigslist.ca/search/sss?query=kona bike&srchType=A"
    assert got.h == base + "&s=200"
    assert got.r == base + "&format=rss&s=50"


def test_request_defaults(many):
    today = F.lit(date(2013, 1, 5))
    urls = ["http://h/?cityName=&pageNumber=3", "http://h/?cityName=victoria&stolenDate=2012/12/2"]
    assert many(urls, web.request_city) == ["vancouver", "victoria"]
    assert many(urls, web.request_page) == ["3", "0"]
    assert many(urls, lambda u: web.request_date(u, today)) == [date(2013, 1, 5), date(2012, 12, 2)]
    shown = many(urls, lambda u: web.date_shown(web.request_date(u, today)))
    assert shown == ["2013/1/5", "2012/12/2"]
    assert many(urls, lambda u: web.date_argument(web.request_date(u, today))) == [
        "201315",
        "2012122",
    ]
    assert many(["http://h/?stolenDate=soon"], lambda u: web.request_date(u, today)) == [None]


def test_page_number(many):
    assert many(["0", "4", "x", "", None], web.page_number) == [0, 4, None, None, None]


def test_city(many):
    urls = ["http://vancouver.en.x.ca/a", "https://www.x.ca", "/relative", "http://h:80/", None]
    assert many(urls, web.city_of) == ["vancouver", "www", None, "h", None]
    got = many(urls, lambda u: F.coalesce(web.in_city(u, "vancouver"), F.lit(False)))
    assert got == [True, False, False, False, False]


def test_terms(many):
    texts = ["Yellow KONA bike", "kona only", "", None]
    got = many(texts, lambda t: web.contains_all_terms(t, " Kona  BIKE "))
    assert got == [True, False, False, None]
    got = many(texts, lambda t: web.contains_all_terms_of(t, F.lit(" Kona  BIKE ")))
    assert got == [True, False, False, None]


def test_sort_keys(many):
    assert many(["31-12-2012", "02-01-2013"], tables.date_sort_key) == ["20121231", "20130102"]
    texts = ["10", " 9 apples", "-1.5e2x", ".5", "abc", "", "5.", None]
    assert many(texts, tables.numeric_sort_key) == [10.0, 9.0, -150.0, 0.5, 0.0, 0.0, 5.0, 0.0]
    assert tables.sort_kind("12.5") == "numeric"
    assert tables.sort_kind(" 02-01-2013 ") == "date"
    assert tables.sort_kind("b") == "text"
    assert tables.sort_kind("2013") == "numeric"


def test_week_number(many):
    moments = [
        "2012-01-01 00:00:00",
        "2012-01-07 00:00:00",
        "2012-01-08 00:00:00",
        "2012-12-31 00:00:00",
        "2013-01-06 00:00:00",
        "2012-01-07 12:00:00",
        "2012-01-07 00:00:00.001",
        "2012-01-07 00:00:00.0004",
    ]
    got = many(moments, lambda t: tables.week_number(F.to_timestamp(t)))
    assert got == [1, 1, 2, 53, 2, 2, 2, 1]


def test_row_flag(spark):
    frame = spark.createDataFrame(
        [(1, "err", 5.1), (2, "err", 5.0), (3, "ok", 9.0)], "i int, k string, v double"
    )
    flag = tables.row_flag(F.col("k"), "err", F.col("v"), 5.0)
    rows = frame.select("i", flag.alias("f")).orderBy("i").collect()
    assert [r.f for r in rows] == ["warning", None, None]


def test_a_body_may_nest_its_tag_in_any_case(many):
    page = '<section class="userbody">a<Section>b</SECTION>c</section>d'
    selector = HTML_SEARCH.detail.body
    assert many([page], lambda t: found(t, selector)) == ["abc"]


def test_bare_attribute_values(many):
    tags = ["<a href=/x>", "<a href='/x y'>", '<a title=q href="">', "<a hrefs=/x>", "<a>"]
    assert many(tags, lambda t: html.attribute_of(t, "href")) == ["/x", "/x y", "", None, None]
