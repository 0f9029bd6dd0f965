"""Landed-page tables rendered from the test tables, one page or row per table row.

The operators read pages; the test tables hold columns. Rendering known columns as markup gives
page tables of any size whose right answers are the columns themselves. Groups are bounded by
construction: order keys are unique, so a block of consecutive keys has a fixed number of orders.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fencewatch.functions.web import search_url
from fencewatch.settings import HTML_SEARCH, RSS_SEARCH, DetailPageSelectors, Selector

SITE = "example.org"
YEAR = 2000
HTML_RULES = replace(HTML_SEARCH, site=SITE)
RSS_RULES = replace(RSS_SEARCH, site=SITE)
HTML_BLOCK = 144
RSS_BLOCK = 72
NO_SUCH_STATUS = "X"
ARTICLE_PAGE = DetailPageSelectors(
    title=Selector("h1"), time=Selector("time"), body=Selector("article")
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task renders.
ROWS_OF_A_TASK = 100_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The same rows, in as many parts as their number asks for; rows of one key stay together.

    A few narrow columns become long texts: parts of a file of the usual size would be too much for a task.
    """
    parts = -(-rows.count() // ROWS_OF_A_TASK)
    return rows.repartition(parts, key) if parts > 1 else rows


def _text(column: Column) -> Column:
    return column.cast("string")


def _when(condition: Column, value: Column | str) -> Column:
    return F.when(condition, value).otherwise("")


def town(block: Column) -> Column:
    return F.concat(F.lit("town"), _text(block))


def order_link(key: Column, block: Column) -> Column:
    return F.concat(
        F.lit("http://"), town(block), F.lit(f".en.{SITE}/bik/"), _text(key), F.lit(".html")
    )


_ORDER_COLUMNS = (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
)


def order_listings(spark: SparkSession, sf_dir: str, block_size: int = HTML_BLOCK) -> DataFrame:
    """The columns that a result row of an order shows."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS).withColumn(
        "block", F.expr(f"o_orderkey div {block_size}")
    )
    date_text = F.date_format("o_orderdate", " MMM dd")
    price = F.concat(F.lit("$"), _text(F.floor("o_totalprice")))
    return orders.select(
        "o_orderkey",
        "block",
        "o_orderstatus",
        order_link(key, F.expr(f"o_orderkey div {HTML_BLOCK}")).alias("link_url"),
        F.when(key % 19 == 0, " Foo 99").otherwise(date_text).alias("date_text"),
        F.when(key % 13 == 0, "").otherwise(price).alias("price"),
        F.when(key % 17 != 0, F.concat(F.lit(" ("), "o_orderpriority", F.lit(")"))).alias("area"),
        F.concat(F.lit("order "), _text(key), F.lit(" for "), _text(F.col("o_custkey"))).alias("short"),
        F.col("o_orderpriority").alias("category"),
    )


def result_row() -> Column:
    """One result row: own markup with the elements that are read, attributes quoted or bare."""
    key = F.col("o_orderkey")
    start = F.when(key % 4 == 1, "<p class=row>").when(key % 4 == 2, "<P CLASS='row'>").otherwise('<p class="row">')
    link = F.when(key % 6 == 2, F.concat(F.lit("<a href="), "link_url", F.lit(">"))).otherwise(
        F.concat(F.lit('<a title="t" href="'), "link_url", F.lit('">'))
    )
    area = F.concat(F.lit("<font color=gray>"), "area", F.lit("</font>"))
    return F.concat(
        start,
        F.lit('\n  <span class="itemdate">'),
        "date_text",
        F.lit("</span>\n  "),
        link,
        "short",
        F.lit('</a>\n  <span class="itempp">\t'),
        "price",
        F.lit('</span><span class="itempn">'),
        F.coalesce(area, F.lit("")),
        F.lit('</span>\n  <span class=itemcg><i><a href="/c/">'),
        "category",
        F.lit("</a></i></span>\n</p>\n"),
    )


def _page(rows: Column | str) -> Column:
    return F.concat(
        F.lit('<html><body><a href="/home">home</a>\n<h4>Found</h4>\n'), rows, F.lit("</body></html>")
    )


def html_url(block: Column, status: Column) -> Column:
    return search_url(town(block), status, F.lit(0), HTML_RULES)


def rss_url(block: Column, status: Column) -> Column:
    return search_url(town(block), status, F.lit(0), RSS_RULES)


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, html)``: one page per block of orders and status, and an empty one per block."""
    rows = order_listings(spark, sf_dir).select(
        "block", "o_orderstatus", F.struct("o_orderkey", result_row().alias("row")).alias("entry")
    )
    pages = rows.groupBy("block", "o_orderstatus").agg(
        F.sort_array(F.collect_list("entry")).alias("entries")
    )
    listed = F.array_join(F.transform("entries", lambda e: e["row"]), "")
    filled = pages.select(
        html_url(F.col("block"), F.col("o_orderstatus")).alias("url"), _page(listed).alias("html")
    )
    blocks = rows.select("block").distinct()
    empty = blocks.select(
        html_url(F.col("block"), F.lit(NO_SUCH_STATUS)).alias("url"), _page(F.lit("")).alias("html")
    )
    return filled.unionByName(empty)


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, xml)``: one feed per block and status; every fifth link has two parameters."""
    listings = order_listings(spark, sf_dir, RSS_BLOCK)
    item = F.concat(
        F.lit('<rdf:li rdf:resource="'),
        "link_url",
        _when(F.col("o_orderkey") % 5 == 0, "?k=1&amp;v=2"),
        F.lit('" />\n'),
    )
    grouped = listings.groupBy("block", "o_orderstatus").agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", item.alias("item")))).alias("entries")
    )
    items = F.array_join(F.transform("entries", lambda e: e["item"]), "")
    head = (
        '<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF xmlns:rdf="r">\n'
        '<channel rdf:about="a">\n<title>t</title>\n<items>\n<rdf:Seq>\n'
    )
    filled = grouped.select(
        rss_url(F.col("block"), F.col("o_orderstatus")).alias("url"),
        F.concat(F.lit(head), items, F.lit("</rdf:Seq></items></channel></rdf:RDF>")).alias("xml"),
    )
    empty = listings.select("block").distinct().select(
        rss_url(F.col("block"), F.lit(NO_SUCH_STATUS)).alias("url"),
        F.lit(head + "</rdf:Seq></items></channel></rdf:RDF>").alias("xml"),
    )
    return filled.unionByName(empty)


def requests(spark: SparkSession, sf_dir: str, block_size: int = HTML_BLOCK) -> DataFrame:
    """One request per block and status, one with a bad page argument now and then."""
    block = F.expr(f"o_orderkey div {block_size}").alias("block")
    blocks = table(spark, sf_dir, "orders").select(block).distinct()
    statuses = F.explode(F.array(*[F.lit(s) for s in ("F", "O", "P", NO_SUCH_STATUS)]))
    page = F.when(F.col("block") % 50 == 7, "seven").when(F.col("block") % 50 == 9, "3")
    return blocks.select("block", statuses.alias("terms")).select(
        F.concat(_text(F.col("block")), F.lit("-"), "terms").alias("request_id"),
        town(F.col("block")).alias("city"),
        page.otherwise("0").alias("page"),
        "terms",
    )


def detail_body() -> Column:
    """Text and image script of an order's advert."""
    key = F.col("o_orderkey")
    phone = (
        F.when(key % 3 == 0, F.concat(F.lit(" call 604-555-"), F.lpad(_text(key % 10000), 4, "0"), F.lit(" ")))
        .when(key % 3 == 1, F.concat(F.lit(" ring 708 555 0"), F.lpad(_text(key % 1000), 3, "0"), F.lit(" ")))
        .otherwise("")
    )
    # sequence() counts downwards for an end of -1, so the empty list is written separately.
    urls = F.transform(
        F.sequence(F.lit(1).cast("bigint"), key % 12),
        lambda i: F.concat(F.lit('"http://img.example.org/'), _text(key), F.lit("_"), _text(i), F.lit('.jpg"')),
    )
    listed = _when(key % 12 > 0, F.array_join(urls, ","))
    script = F.concat(F.lit("<script>var imgList = ["), listed, F.lit("];</script>"))
    return F.concat(
        F.lit("\n<b>For sale</b>\t"),
        _when(key % 8 == 3, "<Section>more </SECTION>"),
        F.repeat(F.lit("word "), (key % 200).cast("int")),
        phone,
        _when(key % 12 != 11, script),
    )


def detail_pages(spark: SparkSession, sf_dir: str, some_missing: bool = True) -> DataFrame:
    """``(url, html, fetched_at)``: adverts of orders, some landed twice, some not unless asked for all."""
    key = F.col("o_orderkey")
    block = F.expr(f"o_orderkey div {HTML_BLOCK}")
    title = F.concat(
        F.lit('<h2 class="postingtitle">Order '), _text(key), F.lit(" snapshot "), _text(F.col("fetched_at")), F.lit("</h2>")
    )
    time = F.concat(F.lit("<time>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</time>"))
    section = F.concat(F.lit('<section class="userbody">'), detail_body(), F.lit("</section>"))
    snapshots = F.when(key % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    if some_missing:
        orders = orders.where(key % 97 != 5)
    orders = spread(orders, "o_orderkey")
    return orders.withColumn("fetched_at", F.explode(snapshots)).select(
        order_link(key, block).alias("url"),
        F.concat(
            F.lit("<html><head><title>x</title></head><body>"),
            _when(key % 89 != 3, title),
            _when(key % 7 != 0, time),
            _when(key % 83 != 4, section),
            F.lit("</body></html>"),
        ).alias("html"),
        "fetched_at",
    )


def image_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(listing_id, images)``: a part's joined image ids, with an empty id for some."""
    key = F.col("p_partkey")
    ids = F.transform(
        F.sequence(F.lit(1), F.lit(7)),
        lambda line: F.when((key % 23 == 0) & (line == 3), "").otherwise(
            F.concat(F.lit("p"), _text(key), F.lit("-"), _text(line), F.lit(".jpg"))
        ),
    )
    return table(spark, sf_dir, "part").select(
        key.alias("listing_id"), F.array_join(ids, "XKRXKRXKR").alias("images")
    )


def count_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_uri, http_status, html)``: the count is how often a part is on that order line."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(
        F.count("*").alias("n")
    )
    part = F.col("l_partkey")
    # Some counts are large enough to be written with digit groups.
    stated = F.col("n") * F.when(part % 3 == 0, 1234).otherwise(1)
    return counts.select(
        F.concat(
            F.lit("http://images.craigslist.org/p"), _text(part), F.lit("-"), _text(F.col("l_linenumber")), F.lit(".jpg")
        ).alias("image_uri"),
        F.when(part % 11 == 0, 503).otherwise(200).alias("http_status"),
        F.concat(
            F.lit("<div>\n<h2><span>"),
            F.format_number(stated, 0),
            F.when(stated == 1, "</span> Result").otherwise("</span> Results"),
            F.lit("</h2></div>"),
        ).alias("html"),
    )


def line_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(listing_id, pos, image_uri)``: one image per order line."""
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("listing_id"), (line - 1).alias("pos"), line_image_uri().alias("image_uri")
    )


def line_image_uri() -> Column:
    return F.concat(
        F.lit("http://img.example.org/"), _text(F.col("l_orderkey")), F.lit("_"),
        _text(F.col("l_linenumber")), F.lit("_"), _text(F.col("l_partkey")), F.lit("_"),
        _text(F.col("l_suppkey")), F.lit("_"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit(".jpg"),
    )


def location_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_uri, http_status, html)``: an answer page per order line, found at two addresses."""

    def location(site: str, key: str) -> Column:
        return F.concat(
            F.lit(f'<div class="search-results-location">\n<span title="{site}"><strong>{site}</strong></span>\n<p><a href="http://{site}/'),
            _text(F.col(key)),
            F.lit(f'.jpg" title="x">x</a>\n<a href="http://{site}/" class="url">{site}</a></p>\n</div>\n'),
        )

    return table(spark, sf_dir, "lineitem").select(
        line_image_uri().alias("image_uri"),
        F.lit(200).alias("http_status"),
        F.concat(
            F.lit("<h2><span>2</span> Results</h2>\n"),
            location("parts.example.org", "l_partkey"),
            location("orders.example.org", "l_orderkey"),
        ).alias("html"),
    )


#: Locations that one page of an image answer lists.
ANSWER_PAGE = 10


def answer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, image_uri, http_status, html)``: an answer per part, its order lines ten to a page; some pages fail."""
    part = F.col("l_partkey")
    line = F.struct("l_orderkey", "l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(part, line.alias("line"))
    listed = lines.groupBy("l_partkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    last = F.floor((F.size("lines") - 1) / ANSWER_PAGE).cast("int")
    pages = listed.select("l_partkey", "lines", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("page"))

    def address(page: Column) -> Column:
        return F.concat(F.lit("http://find.example.org/search/"), _text(part), F.lit("/?page="), _text(page + 1), F.lit("&sort=score"))

    location = F.transform(
        F.slice("lines", F.col("page") * ANSWER_PAGE + 1, ANSWER_PAGE),
        lambda x: F.concat(
            F.lit('<div class="search-results-location">\n<p><a href="http://lines.example.org/'), _text(x["l_orderkey"]),
            F.lit("/"), _text(x["l_linenumber"] % 3), F.lit('.jpg">x</a></p>\n</div>\n'),
        ),
    )
    back = _when(F.col("page") > 0, F.concat(F.lit('<a href="'), address(F.col("page") - 1), F.lit('">« Prev</a>')))
    forth = F.concat(F.lit('<a href="'), F.replace(address(F.col("page") + 1), F.lit("&"), F.lit("&amp;")), F.lit('">Next »</a>'))
    return pages.select(
        address(F.col("page")).alias("url"),
        F.when(F.col("page") == 0, F.concat(F.lit("http://images.example.org/"), _text(part), F.lit(".jpg"))).alias("image_uri"),
        F.when((part % 13 == 5) & (F.col("page") == 1), 503).otherwise(200).alias("http_status"),
        F.concat(
            F.array_join(location, ""), F.lit('<div class="pagination">'), back, F.lit('<span class="current">'),
            _text(F.col("page") + 1), F.lit("</span>"), _when(F.col("page") < F.col("last"), forth), F.lit("</div>"),
        ).alias("html"),
    )


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, city, terms)``: for every page a request in its city for parts of its title, and common words."""
    title = F.regexp_replace(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1), "<[^>]*>", "")
    key = F.col("page_id")
    parts = table(spark, sf_dir, "pages").select("page_id", "url", F.split(title, " ").alias("words"))
    first, second = F.get("words", F.lit(0)), F.get("words", F.lit(1))
    terms = F.concat_ws(
        " ",
        F.when(key % 2 == 0, F.upper(F.substring(first, 1, 5))).otherwise(F.substring(first, 2, 3)),
        F.when(key % 3 == 0, F.substring(second, 1, 4)),
        F.when(key % 5 == 0, "e"),
        F.when(key % 7 == 0, "th"),
        F.when(key % 41 == 0, "no such words"),
    )
    return parts.select(
        _text(key).alias("request_id"), F.regexp_extract("url", r"^[a-z]+://([^/?#.:]+)", 1).alias("city"), terms.alias("terms")
    )


def thefts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(part_key, stolen_on)``: a day on which each part was stolen."""
    day = F.date_add(F.lit("1992-06-01").cast("date"), (F.col("p_partkey") * 37 % 2600).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), day.alias("stolen_on"))


def part_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(part_key, posted, listing_id)``: every order line as an advert of its part."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part_key"), F.col("l_shipdate").cast("date").alias("posted"), F.col("l_orderkey").alias("listing_id")
    )


def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(o_orderkey, cell)``: arrays of one to three objects whose names come in different orders."""
    key, odd = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 1

    def shown(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    total = shown("total", _text(F.floor("o_totalprice")))
    status = shown("status", F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
    nested = shown("more", F.lit('{"x":[1,2]}'))
    first = F.when(odd, F.concat_ws(",", total, status, nested)).otherwise(F.concat_ws(",", nested, status, total))
    second = F.concat_ws(",", status, shown("other", F.lit("true")), shown("total", F.lit("null")))
    objects = F.array(F.concat(F.lit("{"), first, F.lit("}")), F.concat(F.lit("{"), second, F.lit("}")), F.lit('{"total":"a, b"}'))
    some = F.array_join(F.slice(objects, F.lit(1), (key % 4).cast("int")), ", ")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("["), some, F.lit("]")).alias("cell"))


def register_rows(spark: SparkSession, sf_dir: str, serial: bool = True) -> DataFrame:
    """A property register of the parts, in the column order of the register files.

    Without ``serial`` models have no word of their own: many parts then ask for the same common words.
    """
    key = F.col("p_partkey")
    own_word = F.concat(F.lit(" SN"), _text(F.expr("p_partkey div 4"))) if serial else F.lit("")
    colours = F.array(*[F.lit(c) for c in ("BLK", "BLU", "BRNBLK", "SILRED", "XYZ")])
    blank = F.lit(None).cast("string")
    columns = {
        "Jurisdiction Code": F.lit("X9"),
        "Report Year": _text(2012 + key % 2),
        "Occurence Number": _text(key),
        "Property Case Status": F.lit("1"),
        "Item Status": F.lit("1"),
        "Manufacturer's name": F.upper(F.concat(maker(), F.lit(" CO"))),
        "Style": F.lit("Z"),
        "Model": F.concat(_when(key % 9 != 0, F.upper("p_name")), own_word),
        "Color": F.when(key % 8 != 0, F.get(colours, (key % 5).cast("int"))),
        "Type": F.lit("Q7"),
        "Seed": _text(F.col("p_size")),
        "Serial number": blank,
        "Plate or Sticker": blank,
        "Brake Type": blank,
        "Fender Type": blank,
        "Frame Size": blank,
        "Handle Bars": blank,
        "Registration Number": blank,
        "Wheel size": blank,
        "Seat style": blank,
    }
    return table(spark, sf_dir, "part").select(*[c.alias(n) for n, c in columns.items()])


MAKERS = ("velodor", "quickwheel", "mountaria", "pedalio", "rovano", "zirk")


def maker(shift: int = 0) -> Column:
    names = F.array(*[F.lit(m) for m in MAKERS])
    return F.get(names, ((F.col("p_partkey") + shift) % len(MAKERS)).cast("int"))


def misspelt(word: Column) -> Column:
    """The word without its second letter for every third part."""
    shorter = F.concat(F.substring(word, 1, 1), F.substring(word, 3, 100))
    return F.when(F.col("p_partkey") % 3 == 0, shorter).otherwise(word)


def part_adverts(spark: SparkSession, sf_dir: str, serial: bool = True) -> DataFrame:
    """``(listing_id, text)``: an advert per part; makes are misspelt now and then."""
    key = F.col("p_partkey")
    own_word = [F.concat(F.lit("SN"), _text(F.expr("p_partkey div 4")))] if serial else []
    colours = F.array(*[F.lit(c) for c in ("black", "blue", "brown and black", "silver red", "xyz")])
    return table(spark, sf_dir, "part").select(
        key.alias("listing_id"),
        F.concat_ws(
            " ", F.lit("Selling my"), misspelt(maker()), F.lit("co"), "p_name", *own_word,
            F.get(colours, (key % 5).cast("int")),
        ).alias("text"),
    )


def encoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, content)``: pages landed as bytes, in UTF-8, UTF-16 and Windows-1252, declared or not."""
    kind = F.col("kind")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.concat("html", F.lit("<!-- “5 €” – š -->")).alias("html")
    )
    narrow = ~F.col("html").rlike("[^\x00-\xFF“€”–š]")
    kinded = pages.withColumn("kind", F.when(narrow, F.col("page_id") % 6).otherwise(F.col("page_id") % 4))
    declared = F.replace("html", F.lit('charset="utf-8"'), F.when(kind == 4, 'charset="Windows-1252"').otherwise('name="x"'))
    high, latin = "“€”–š", "\x93\x80\x94\x96\x9a"
    return kinded.select(
        "page_id",
        "url",
        F.when(kind == 0, F.encode("html", "UTF-8"))
        .when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8")))
        .when(kind == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE")))
        .when(kind == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode("html", "UTF-16BE")))
        .otherwise(F.encode(F.translate(declared, high, latin), "ISO-8859-1"))
        .alias("content"),
    )


def form_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(c_custkey, url)``: addresses as the search form makes them, fields left out at times."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key,
        F.concat(
            F.lit("http://localhost/find.htm?itemDescription="),
            F.replace(F.lower("c_mktsegment"), F.lit("h"), F.lit("%68")),
            F.lit("+"),
            _text(F.col("c_nationkey")),
            _when(key % 2 == 0, F.concat(F.lit("&cityName=city"), _text(F.col("c_nationkey")))),
            _when(key % 3 != 0, F.concat(F.lit("&pageNumber="), _text(key % 5))),
            _when(key % 7 == 0, "x"),
            _when(key % 5 != 0, F.concat(F.lit("&stolenDate=2012/"), _text(key % 12 + 1), F.lit("/"), _text(key % 28 + 1))),
            F.lit("#top"),
        ).alias("url"),
    )
