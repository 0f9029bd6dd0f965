"""Registered queries: each runs one or more operators over whole test tables.

"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fencewatch.functions import advert, tables, web
from fencewatch.functions.score import text_points
from fencewatch.operators import images as image_ops
from fencewatch.operators import learning, matching, price_levels, signals
from fencewatch.operators import words as word_ops
from fencewatch.operators.asof import first_adverts
from fencewatch.operators.chains import answer_locations
from fencewatch.operators.contains import answers, search_requests
from fencewatch.operators.details import join_details, read_details
from fencewatch.operators.filters import adverts_with_terms
from fencewatch.operators.feeds import feed_links, summarise_feeds
from fencewatch.operators.output import response_json, wire_json
from fencewatch.operators.ranking import ranked_adverts
from fencewatch.operators.register import (
    colour_names,
    make_model_colour,
    match_register,
    match_register_sets,
    register_items,
    reported_in,
    reported_since,
)
from fencewatch.operators.results import (
    find_result_pages,
    guard_results,
    one_page_of_rows,
    page_links,
    result_rows,
    summarise_result_pages,
    with_search_url,
)
from fencewatch.operators.tables import kind_of_column, typed_sort, with_lookup_link
from fencewatch.plans.image_lookup import look_up_images
from fencewatch.plans.register_job import match_reported_items
from fencewatch.plans.search import newest_details, search_html, search_rss
from fencewatch.settings import PhoneRule, SearchRules
from fencewatch.sources.landed import decoded_pages
from fencewatch.sources.json_rows import array_rows, object_fields, read_json_rows
from fencewatch.sources.register import read_register
from fencewatch.sources.scratch import fresh_path, written
from fencewatch.workload import render
from fencewatch.workload.render import HTML_RULES, RSS_RULES, YEAR, table

DOCUMENT_PHONES = PhoneRule(area_codes=("743", "771"))
TODAY = "2013-01-05"

Query = Callable[[SparkSession, str], DataFrame]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def _joined(images: str = "images") -> Column:
    return F.array_join(images, "|")


def _all_rows() -> SearchRules:
    return replace(HTML_RULES, max_results=None)


# --- scalar functions -------------------------------------------------------------------------


def page_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages to scored adverts."""
    pages = _pages(spark, sf_dir)
    scored = read_details(pages, render.ARTICLE_PAGE, DOCUMENT_PHONES, keep=["page_id"])
    return scored.select(
        "page_id",
        "link_url",
        "title",
        "description",
        "phone_number",
        "dodgy_score",
        "dodgy_description",
        "parse_status",
    )


def page_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: pages landed as bytes in five encodings, decoded by what each of them tells."""
    pages = decoded_pages(render.encoded_pages(spark, sf_dir))
    return pages.select("page_id", "charset", F.length("html").alias("n_chars"), F.md5("html").alias("html_md5"))


def page_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, C4: every link of every page."""
    pages = _pages(spark, sf_dir)
    return page_links(pages, keep=["page_id"]).drop("url")


def phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10, C21."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    number = advert.phone_number(F.col("text"), DOCUMENT_PHONES)
    return documents.select("doc_id", number.alias("phone_number"))


def text_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8, C12, F3 on plain documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").select(
        "doc_id",
        advert.whitespace_count(F.col("text")).alias("whitespace"),
        F.length(advert.description(F.col("text"))).alias("description_length"),
    )
    return documents.withColumn("text_points", text_points(F.col("whitespace")))


def url_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        web.url_param(url, "page").alias("page"),
        web.url_param(url, "ref").alias("ref"),
        web.url_param(url, "utm_source").alias("utm_source"),
    )


def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form addresses to search requests."""
    url = F.col("url")
    today = F.lit(TODAY).cast("date")
    parsed = render.form_requests(spark, sf_dir).select(
        "c_custkey",
        web.request_city(url).alias("city"),
        web.request_page(url).alias("page"),
        web.url_param(url, "itemDescription").alias("terms"),
        web.date_shown(web.request_date(url, today)).alias("date_shown"),
        web.date_argument(web.request_date(url, today)).alias("date_argument"),
    )
    return with_search_url(parsed, HTML_RULES)


def week_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C19."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", tables.week_number(F.col("ts")).alias("week"))


def row_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9."""
    flag = tables.row_flag(F.col("event_type"), "error", F.col("value"), 10.0)
    return table(spark, sf_dir, "events").select("event_id", "event_type", flag.alias("flag"))


def link_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return with_lookup_link(orders, "user_lookup", "./userLookup.htm?deviceProxyId=", "o_custkey")


# --- filters ----------------------------------------------------------------------------------


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms in title and description."""
    pages = _pages(spark, sf_dir)
    adverts = read_details(pages, render.ARTICLE_PAGE, keep=["page_id"])
    return adverts_with_terms(adverts, "THE  of").select("page_id", "link_url")


def request_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2 for a table of requests: adverts of the request's city that contain all its terms."""
    pages = read_details(_pages(spark, sf_dir), render.ARTICLE_PAGE, keep=["page_id"])
    adverts = pages.select(
        F.col("page_id").alias("advert_id"),
        web.city_of(F.col("link_url")).alias("city"),
        F.concat_ws(" ", "title", "description").alias("text"),
    )
    found, members = search_requests(render.page_requests(spark, sf_dir), adverts)
    return answers(found, members).select("request_id", F.col("advert_id").alias("page_id"))


def city_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    city = web.city_of(F.col("url")).alias("city")
    return pages.where(web.in_city(F.col("url"), "blog")).select("page_id", "url", city)


def posted_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, C1 on result rows, with a theft date per category."""
    rows = result_rows(render.result_pages(spark, sf_dir), YEAR, HTML_RULES)
    recent = signals.posted_after(rows, _stolen_by_category())
    return recent.select("link_url", "category", "date_posted_parsed")


# --- searches ---------------------------------------------------------------------------------


def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of result pages, without a guard."""
    rows = result_rows(render.result_pages(spark, sf_dir), YEAR, _all_rows())
    return rows.select(
        "url",
        "pos",
        "link_url",
        "short_title",
        "date_text",
        "date_posted_parsed",
        "price",
        "sale_area",
        "category",
    )


def result_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each request."""
    summaries = summarise_result_pages(render.result_pages(spark, sf_dir), YEAR, HTML_RULES)
    asked = with_search_url(render.requests(spark, sf_dir), HTML_RULES)
    guarded = guard_results(find_result_pages(asked, summaries), HTML_RULES)
    return guarded.select("request_id", "n_rows", "status", "status_title", "status_description")


def rss_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, D4, D5."""
    summaries = summarise_feeds(render.feeds(spark, sf_dir), RSS_RULES)
    asked = with_search_url(render.requests(spark, sf_dir, render.RSS_BLOCK), RSS_RULES)
    guarded = guard_results(find_result_pages(asked, summaries), RSS_RULES)
    return guarded.select("request_id", "n_rows", "status", "status_title", "status_description")


def rss_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, B2."""
    return feed_links(render.feeds(spark, sf_dir))


def detail_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with the fields of their detail pages."""
    rows = result_rows(render.result_pages(spark, sf_dir), YEAR, _all_rows())
    rows = written(rows.select("url", "pos", "link_url"), "linked-rows")
    details = newest_details(render.detail_pages(spark, sf_dir), HTML_RULES, asked=rows.select("link_url"))
    joined = join_details(rows, details)
    return joined.select(
        "url",
        "pos",
        "link_url",
        "title",
        "date_posted",
        "description",
        _joined().alias("images"),
        F.size("images").alias("n_images"),
        "phone_number",
        "dodgy_score",
        "dodgy_description",
        "parse_status",
    )


def _html_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_html(
        render.requests(spark, sf_dir),
        render.result_pages(spark, sf_dir),
        render.detail_pages(spark, sf_dir),
        YEAR,
        HTML_RULES,
    )


def html_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole HTML search: A1-A4, B1, B4, C1-C14, C22, D3, D5, E1, E2, G5, H1."""
    return _html_listings(spark, sf_dir).select(
        "request_id",
        "status",
        "pos",
        "link_url",
        "title",
        "description",
        "date_posted",
        _joined().alias("images"),
        "phone_number",
        "dodgy_score",
        "dodgy_description",
        "price",
        "sale_area",
        "short_title",
        "category",
        "date_posted_parsed",
        "parse_status",
    )


def html_search_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 in the HTML search: adverts since the theft, and a status row where none is left."""
    listings = search_html(
        render.requests(spark, sf_dir),
        render.result_pages(spark, sf_dir),
        render.detail_pages(spark, sf_dir),
        YEAR,
        HTML_RULES,
        stolen_on=F.make_date(F.lit(YEAR), F.lit(11), F.lit(15)),
    )
    return listings.select(
        "request_id", "status", "pos", "link_url", "title", "description", "dodgy_score", "date_posted_parsed"
    )


def rss_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole RSS search: A3, A4, B2, C7-C14, D4, D5, E3, H1."""
    listings = search_rss(
        render.requests(spark, sf_dir, render.RSS_BLOCK),
        render.feeds(spark, sf_dir),
        render.detail_pages(spark, sf_dir),
        RSS_RULES,
    )
    return listings.select(
        "request_id",
        "status",
        "pos",
        "link_url",
        "title",
        "description",
        "date_posted",
        _joined().alias("images"),
        "phone_number",
        "dodgy_score",
        "price",
        "category",
        "parse_status",
    )


def listing_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing or status row as a wire object."""
    return wire_json(_html_listings(spark, sf_dir), "request_id", "pos")


def response_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array per request."""
    return response_json(_html_listings(spark, sf_dir), HTML_RULES)


# --- images -----------------------------------------------------------------------------------


def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3."""
    return image_ops.image_rows(render.image_lookups(spark, sf_dir))


def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, B3, C15, D7, E4."""
    images = image_ops.image_rows(render.image_lookups(spark, sf_dir))
    return image_ops.count_matches(images, render.count_pages(spark, sf_dir))


def image_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole image lookup: A5, A8, B3, C15, D7, E4, F4, H2."""
    return look_up_images(render.image_lookups(spark, sf_dir), render.count_pages(spark, sf_dir))


def image_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many adverts share an original, per original."""
    locations = image_ops.match_locations(render.location_pages(spark, sf_dir))
    used = image_ops.originals_used(render.line_images(spark, sf_dir), locations)
    return image_ops.adverts_per_original(used)


def shared_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest sharing, per advert."""
    locations = image_ops.match_locations(render.location_pages(spark, sf_dir))
    return image_ops.shared_images(render.line_images(spark, sf_dir), locations)


def image_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each image was found, over all pages of its answer."""
    found = answer_locations(render.answer_pages(spark, sf_dir))
    return found.groupBy("image_uri").agg(F.count("*").alias("places"))


def stock_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many images of an advert are found elsewhere."""
    images = image_ops.image_rows(render.image_lookups(spark, sf_dir))
    counted = image_ops.count_matches(images, render.count_pages(spark, sf_dir))
    listings = table(spark, sf_dir, "part").select("p_partkey")
    return signals.stock_images(listings, counted, "p_partkey")


# --- register ---------------------------------------------------------------------------------


def _register(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "register")
    rows = render.register_rows(spark, sf_dir)
    rows.write.options(sep="\t", header=True, emptyValue="", ignoreLeadingWhiteSpace=False).csv(path)
    return read_register(spark, path)


def register_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register file, read back, of one year."""
    reported = reported_in(_register(spark, sf_dir), "2013")
    return make_model_colour(reported, "Occurence Number").withColumnRenamed(
        "Occurence Number", "occurence_number"
    )


def register_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports since last year, counted by year."""
    recent = reported_since(_register(spark, sf_dir), F.lit("2014-02-01").cast("date"))
    return recent.groupBy(F.col("Report Year").alias("report_year")).agg(F.count("*").alias("n"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    register = render.register_rows(spark, sf_dir)
    names = F.array_join(colour_names(F.col("Color")), " and ")
    return register.select(F.col("Occurence Number").alias("occurence_number"), names.alias("colours"))


def make_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of adverts that are a maker's name, misspelt or not."""
    adverts = render.part_adverts(spark, sf_dir)
    vocabulary = adverts.select(F.explode(matching.words(F.col("text"))).alias("token")).distinct()
    makes = render.register_rows(spark, sf_dir).select(
        F.explode(matching.words(F.col("Manufacturer's name"))).alias("term")
    )
    return matching.canonical_words(vocabulary, makes.distinct())


def register_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register items and the adverts that have all their words."""
    items = register_items(render.register_rows(spark, sf_dir), "Occurence Number")
    return match_register(items, render.part_adverts(spark, sf_dir))


def register_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole register job: A6, C16, D8, J2-J4."""
    return match_reported_items(
        _register(spark, sf_dir), render.part_adverts(spark, sf_dir), "2013"
    )


def register_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2-J4 by common words alone: each set of words that items ask for, how many do, and the adverts that have them."""
    items = register_items(render.register_rows(spark, sf_dir, serial=False), "Occurence Number")
    matches, members = match_register_sets(items, render.part_adverts(spark, sf_dir, serial=False))
    sizes = members.groupBy("set_id", F.array_join("terms", " ").alias("terms")).agg(F.count("*").alias("n_items"))
    return matches.join(sizes, "set_id").select("terms", "n_items", "listing_id")


def register_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best adverts of every item, by common words alone."""
    items = register_items(render.register_rows(spark, sf_dir, serial=False), "Occurence Number")
    best, members = ranked_adverts(items, render.part_adverts(spark, sf_dir, serial=False), k=3)
    return members.join(best, "set_id").select("item_id", "rank", "listing_id", "score")


# --- table helpers ----------------------------------------------------------------------------


def _order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "dd-MM-yyyy").alias("day"),
        F.concat(
            F.when(F.col("o_orderkey") % 7 == 0, "n/a ").otherwise(" "),
            F.floor("o_totalprice").cast("string"),
            F.lit(" dollars"),
        ).alias("price"),
        "o_orderpriority",
    )


def typed_sort_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G2, G4."""
    return typed_sort(_order_texts(spark, sf_dir), "day", "date", ["o_orderkey"])


def typed_sort_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G3, G4."""
    return typed_sort(_order_texts(spark, sf_dir), "price", "numeric", ["o_orderkey"], True)


def typed_sort_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G4."""
    return typed_sort(_order_texts(spark, sf_dir), "o_orderpriority", "text", ["o_orderkey"])


def typed_sort_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 with the kind told from the second row."""
    texts = _order_texts(spark, sf_dir)
    kind = kind_of_column(texts, "price", ["o_orderkey"])
    return typed_sort(texts, "price", kind, ["o_orderkey"])


def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6 far down: page 20 of every status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return one_page_of_rows(orders, "o_orderstatus", order, page=20, page_size=100)


def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 100 orders for every status, dearest first."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return one_page_of_rows(orders, "o_orderstatus", order, page=2, page_size=100)


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects written out, read back as text columns."""
    path = fresh_path(spark, "json-rows")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    customer.write.json(path)
    schema = "c_custkey string, c_name string, c_nationkey string"
    return read_json_rows(spark, path, multi_line=False, schema=schema)


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 with the objects in a column."""
    fields = F.explode(object_fields(F.col("props"))).alias("field", "value")
    return table(spark, sf_dir, "events").select("event_id", fields)


def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays in cells, with the names of the first object in its order."""
    rows = array_rows(render.json_arrays(spark, sf_dir), "cell", "o_orderkey")
    return rows.select("o_orderkey", "pos", F.posexplode("fields").alias("place", "field")).select(
        "o_orderkey", "pos", "place", "field.name", "field.value"
    )


# --- further signals --------------------------------------------------------------------------


def phone_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8."""
    return signals.phone_reuse(written(phone(spark, sf_dir), "phones"))


def price_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of a result row against the mean of its page."""
    rows = result_rows(render.result_pages(spark, sf_dir), YEAR, _all_rows())
    prices = written(rows.select("url", "link_url", "price"), "prices")
    ratios = signals.price_outlier(prices, "url")
    amount = F.col("amount").cast("double").alias("amount")
    return ratios.select("url", "link_url", amount, "price_ratio")


def price_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 without a mean: where a price stands in its search, from merged sketches of each day."""
    rows = result_rows(render.result_pages(spark, sf_dir), YEAR, _all_rows())
    rows = written(rows.select("url", "link_url", "price", "date_posted_real"), "prices")
    sketches = written(price_levels.price_sketches(rows, "url", "date_posted_real"), "price-sketches")
    levels = price_levels.price_level(rows, sketches, "url")
    return levels.select("url", "link_url", "amount", "price_eighth", F.round("median_ratio", 6).alias("median_ratio"))


def price_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of a result row against a table of average prices."""
    rows = result_rows(render.result_pages(spark, sf_dir), YEAR, _all_rows())
    known = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(
        F.max("o_totalprice").alias("average_price")
    )
    ratios = signals.price_against_known(rows.select("link_url", "category", "price"), known)
    return ratios.select("link_url", "category", "known_price_ratio")


def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12."""
    details = newest_details(render.detail_pages(spark, sf_dir, some_missing=False), HTML_RULES)
    fields = ["title", "date_posted", "description", "images", "phone_number"]
    return signals.missing_fields(details, fields).select("link_url", "missing_fields")


def word_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the words of labelled texts say."""
    texts, labels = _labelled_texts(spark, sf_dir)
    weights = word_ops.word_weights(texts, labels)
    return weights.withColumn("weight", F.col("weight").cast("double"))


def word_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts scored by the words learnt."""
    texts, labels = _labelled_texts(spark, sf_dir)
    weights = written(word_ops.word_weights(texts, labels), "word-weights")
    return word_ops.word_score(texts, weights).withColumnRenamed("text_id", "doc_id")


def _labelled_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("text_id"), F.col("toxic").alias("bad"))
    return texts, labels


def _stolen_by_category() -> Column:
    return F.make_date(F.lit(YEAR), F.substring("category", 1, 1).cast("int") * 2, F.lit(15))


def _past_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("delay_days"))


def _area_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("area"))
    return areas.agg(F.count("*").alias("weight"))


def signal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basic score, each signal's points, and the total."""
    rows = result_rows(render.result_pages(spark, sf_dir), YEAR, _all_rows())
    details = newest_details(render.detail_pages(spark, sf_dir, some_missing=False), HTML_RULES)
    basic = rows.select("url", "link_url", "price", "sale_area", "category", "date_posted_real").join(
        details.select("link_url", "title", "date_posted", "phone_number", "dodgy_score"), "link_url"
    )
    key = F.regexp_extract("link_url", r"/(\d+)\.html$", 1).cast("long")
    stored = written(basic.withColumn("listing_id", key), "basic-scores")
    listings = signals.missing_fields(stored, ["title", "date_posted", "phone_number"])
    listings = signals.phone_reuse(listings, stored=stored)
    listings = signals.price_outlier(listings, "url", stored=stored)
    listings = signals.delay_gap(listings, _past_delays(spark, sf_dir), _stolen_by_category())
    listings = signals.area_weight(listings, _area_weights(spark, sf_dir))
    listings = signals.on_watch_list(listings, _watched_phones(spark, sf_dir))
    listings = listings.join(shared_images(spark, sf_dir), "listing_id", "left")
    counted = image_ops.count_matches(
        image_ops.image_rows(render.image_lookups(spark, sf_dir)), render.count_pages(spark, sf_dir)
    )
    listings = signals.stock_images(listings, counted, "listing_id")
    names = {
        "missing": F.col("missing_fields") * 20,
        "phone": F.when(F.col("phone_adverts") > 1, 100),
        "price": F.when(F.col("price_ratio") < 0.5, 80),
        "delay": F.when(F.col("delay_score") > 1, 50),
        "area": F.when(F.col("area_weight") > 0, 10),
        "watched": F.when(F.col("watched"), 200),
        "shared": F.when(F.col("shared_by") > 1, 60),
        "stock": F.col("stock_images") * 15,
    }
    scored = signals.combine_signals(listings, names)
    points = [F.col("signal_points")[name].alias(f"{name}_points") for name in names]
    return scored.select("link_url", "dodgy_score", *points, "total_score")


SIGNALS = ("text_points", "phone_adverts", "phone_missing", "word_score")


def _document_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of documents with ``bad``, whether their label says low quality; NULL without a label."""
    known = F.col("phone_adverts").isNotNull()
    phones = phone_reuse(spark, sf_dir).select(
        "doc_id", "phone_adverts", F.when(known, 0).otherwise(1).alias("phone_missing")
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    joined = text_score(spark, sf_dir).select("doc_id", "text_points").join(phones, "doc_id")
    return written(joined.join(word_score(spark, sf_dir), "doc_id").join(labels, "doc_id", "left"), "document-signals")


def signal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of signals, learnt from labels in eight Newton steps."""
    weights = learning.learn_weights(_document_signals(spark, sf_dir), SIGNALS)
    places = F.when(F.col("signal") == learning.CONSTANT, F.round("weight", 6)).otherwise(F.round("weight", 8))
    return weights.select("signal", places.alias("weight"))


def signal_learnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the weights learnt, with what each signal adds."""
    known = _document_signals(spark, sf_dir)
    scored = learning.learnt_score(known, learning.learn_weights(known, SIGNALS), SIGNALS)
    points = [F.round(F.col("learnt_points")[name], 6).alias(f"{name}_points") for name in SIGNALS]
    return scored.select("doc_id", F.round("learnt_score", 6).alias("learnt_score"), *points)


def delay_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from theft to advert against past delays."""
    rows = result_rows(render.result_pages(spark, sf_dir), YEAR, _all_rows())
    gaps = signals.delay_gap(rows, _past_delays(spark, sf_dir), _stolen_by_category())
    return gaps.select(
        "link_url", "delay_days", "delay_gap", F.round("delay_score", 6).alias("delay_score")
    )


def first_advert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 with J2: the first advert of every stolen part since the theft, and the days between."""
    found = _first_adverts(spark, sf_dir)
    return found.withColumns({day: F.col(day).cast("string") for day in ("stolen_on", "posted")})


def _first_adverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_adverts(render.thefts(spark, sf_dir), render.part_postings(spark, sf_dir), "part_key")


def delay_learnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11 with delays that were found rather than given: those from theft to first advert."""
    delays = _first_adverts(spark, sf_dir).where(F.col("delay_days").isNotNull()).select("delay_days")
    rows = result_rows(render.result_pages(spark, sf_dir), YEAR, _all_rows())
    gaps = signals.delay_gap(rows, written(delays, "delays"), _stolen_by_category())
    return gaps.select(
        "link_url", "delay_days", F.round("delay_gap", 6).alias("delay_gap"), F.round("delay_score", 6).alias("delay_score")
    )


def area_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13."""
    rows = result_rows(render.result_pages(spark, sf_dir), YEAR, _all_rows())
    return signals.area_weight(rows, _area_weights(spark, sf_dir)).select(
        "link_url", "sale_area", "area_weight"
    )


def _watched_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad((F.col("c_custkey") * 3 % 10000).cast("string"), 4, "0")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("(604) 555-"), number).alias("phone_number")
    )


def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of adverts on a list of numbers."""
    phones = _watched_phones(spark, sf_dir)
    details = newest_details(render.detail_pages(spark, sf_dir, some_missing=False), HTML_RULES)
    return signals.on_watch_list(details, phones).select("link_url", "phone_number", "watched")


QUERIES: dict[str, Query] = {
    "page_score": page_score,
    "page_links": page_link_rows,
    "page_encodings": page_encodings,
    "phone": phone,
    "text_score": text_score,
    "url_param": url_param,
    "request_defaults": request_defaults,
    "week_number": week_number,
    "row_flag": row_flag,
    "link_column": link_column,
    "keyword_search": keyword_search,
    "request_search": request_search,
    "city_filter": city_filter,
    "posted_after": posted_after,
    "summary_rows": summary_rows,
    "result_guard": result_guard,
    "rss_guard": rss_guard,
    "rss_links": rss_links,
    "detail_join": detail_join,
    "html_search": html_search,
    "html_search_after": html_search_after,
    "rss_search": rss_search,
    "listing_json": listing_json,
    "response_array": response_array,
    "image_rows": image_rows,
    "image_counts": image_counts,
    "image_lookup": image_lookup,
    "image_reuse": image_reuse,
    "shared_images": shared_images,
    "image_places": image_places,
    "stock_images": stock_images,
    "register_filter": register_filter,
    "register_recent": register_recent,
    "colours": colours,
    "make_spelling": make_spelling,
    "register_match": register_match,
    "register_job": register_job,
    "register_sets": register_sets,
    "register_rank": register_rank,
    "typed_sort_date": typed_sort_date,
    "typed_sort_numeric": typed_sort_numeric,
    "typed_sort_text": typed_sort_text,
    "typed_sort_sniffed": typed_sort_sniffed,
    "page_offset": page_offset,
    "deep_page": deep_page,
    "json_rows": json_rows,
    "json_fields": json_fields,
    "json_array": json_array,
    "phone_reuse": phone_reuse,
    "price_outlier": price_outlier,
    "price_level": price_level,
    "price_known": price_known,
    "missing_fields": missing_fields,
    "word_weights": word_weights,
    "word_score": word_score,
    "signal_score": signal_score,
    "signal_weights": signal_weights,
    "signal_learnt": signal_learnt,
    "delay_gap": delay_gap,
    "delay_learnt": delay_learnt,
    "first_advert": first_advert,
    "area_weight": area_weight,
    "watch_list": watch_list,
}
