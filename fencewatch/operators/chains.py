"""Answers that go over several landed pages: every page finds the page that its answer began with.

A page names the next one. Turned round, each page points at the one before it; all pointers are jumped at once, so
that each round doubles their reach and an answer of n pages takes about log2(n) rounds. Page text is read
once, before the first round, and left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.operators.images import location_urls
from fencewatch.operators.keyed import dealt, newest_per_key
from fencewatch.sources.scratch import written

_NEXT = r"""(?is)class\s*=\s*["']pagination["'].*?<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>\s*Next\b"""


def next_page(html: Column) -> Column:
    """The address behind the "Next" of a page's pagination; NULL on a last page."""
    link = F.regexp_extract(html, _NEXT, 1)
    return F.when(link != "", F.replace(link, F.lit("&amp;"), F.lit("&")))


def chain_starts(links: DataFrame) -> DataFrame:
    """``(url, start)`` for pages ``(url, next_url, is_start)`` that a start leads to; a start leads to itself.

    ``url`` is unique. Where several pages name the same next one, the smallest address counts. A page
    that no start leads to, in a ring of pages or behind one that was not landed, is left out.
    """
    numbered = written(links.withColumn("page", F.monotonically_increasing_id()), "chain-pages")
    names = numbered.select(F.col("page").alias("start_page"), F.col("url").alias("start"))
    led = numbered.select("page", "url").join(page_starts(numbered), "page")
    return led.join(names, "start_page").select("url", "start")


def page_starts(links: DataFrame) -> DataFrame:
    """``(page, start_page)`` as :func:`chain_starts`, for a stored table ``(page, url, next_url, is_start)`` of numbered pages.

    Addresses are looked up once; what is jumped are numbers, which take a fraction of the memory of a task.
    """
    n_pages = links.count()
    pages = links.select("page", "is_start", "url", F.xxhash64("url").alias("hash"))
    named = links.where(F.col("next_url").isNotNull() & (F.col("next_url") != F.col("url")))
    named = named.select(F.col("next_url").alias("url"), F.xxhash64("next_url").alias("hash"), F.col("url").alias("by"), "page")
    # The hash first: rows are sorted by a number. Grouped before they are dealt, no address is twice on a side of the join.
    before = named.groupBy("hash", "url").agg(F.min_by("page", "by").alias("before"))
    up = F.when(F.col("is_start"), F.col("page")).otherwise(F.col("before"))
    pointers = dealt(pages, n_pages, "hash", "url").join(dealt(before, n_pages, "hash", "url"), ["hash", "url"], "left")
    now = written(pointers.select("page", up.alias("up"), "is_start").where("up IS NOT NULL"), "chain")
    for _ in range(max(now.count(), 1).bit_length() + 1):
        there = now.select(F.col("page").alias("up"), F.col("up").alias("further"))
        jumped = written(now.join(there, "up").select("page", F.col("further").alias("up"), "is_start", (F.col("further") != F.col("up")).alias("moved")), "chain")
        now = jumped.select("page", "up", "is_start")
        if jumped.where("moved").isEmpty():
            break
    starts = now.where("is_start").select(F.col("page").alias("up"))
    return now.join(starts, "up", "left_semi").select("page", F.col("up").alias("start_page"))


def answer_locations(pages: DataFrame) -> DataFrame:
    """Where each looked-up image was found, over all pages of its answer: ``(image_uri, original_url)``, each once.

    ``pages(url, image_uri, http_status, html[, fetched_at])``: only the first page of an answer states its image;
    pages that failed end an answer. Of a page landed several times the newest counts.
    """
    keep = [name for name in ("fetched_at",) if name in pages.columns]
    succeeded = F.col("http_status").between(200, 299)
    read = pages.select(
        "url",
        "image_uri",
        *keep,
        F.when(succeeded, next_page(F.col("html"))).alias("next_url"),
        F.when(succeeded, location_urls(F.col("html"))).alias("urls"),
    )
    order = [F.col(name).desc_nulls_last() for name in keep]
    numbers = {"page": F.monotonically_increasing_id(), "n_urls": F.greatest(F.size("urls"), F.lit(0))}
    newest = written(newest_per_key(read, "url", order).drop(*keep).withColumns(numbers), "answer-pages")
    n_pages, n_found = newest.agg(F.count("*"), F.coalesce(F.sum("n_urls"), F.lit(0))).first()
    starts = page_starts(newest.select("page", "url", "next_url", F.col("image_uri").isNotNull().alias("is_start")))
    images = newest.where(F.col("image_uri").isNotNull()).select(F.col("page").alias("start_page"), "image_uri")
    of_image = starts.join(images, "start_page").select("page", "image_uri")
    # Pages meet their image before their addresses are set apart: one row for each page is sorted, not one for each address.
    listed = newest.where("n_urls > 0").select("page", "urls")
    met = dealt(listed, n_pages, "page").join(dealt(of_image, n_pages, "page"), "page")
    found = met.select("image_uri", F.explode("urls").alias("original_url"))
    return dealt(found, n_found, "image_uri", "original_url").distinct()
