"""RSS result lists: item links in feed order, guarded by their number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.settings import RSS_SEARCH, SearchRules

_ITEM_LIST = r"(?s)<(?:\w+:)?Seq(?:\s[^>]*)?>.*?</(?:\w+:)?Seq\s*>"
_ITEM_LINK = r"""(?s)<(?!(?:\w+:)?Seq[\s>])[\w:.-]+\s+[\w:.-]+\s*=\s*(["'])(.*?)\1"""

# The entities that XML predefines; the ampersand must come last.
XML_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def decode_entities(text: Column) -> Column:
    for entity, character in XML_ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def item_links(xml: Column) -> Column:
    """First attribute of every child of the feed's item list, in order; NULL without a list."""
    listed = F.regexp_substr(xml, F.lit(_ITEM_LIST))
    return F.transform(F.regexp_extract_all(listed, F.lit(_ITEM_LINK), F.lit(2)), decode_entities)


def summarise_feeds(
    feeds: DataFrame, rules: SearchRules = RSS_SEARCH, keep: Sequence[str] = ()
) -> DataFrame:
    """``(url, xml)`` to ``(url, *keep, n_rows, rows)`` with rows of ``(pos, link_url)``.

    A feed without an item list counts as empty; too many items leave the count only.
    """
    links = feeds.select("url", *keep, item_links(F.col("xml")).alias("links"))
    count = F.coalesce(F.size("links"), F.lit(0))
    rows = F.transform("links", lambda url, i: F.struct(i.alias("pos"), url.alias("link_url")))
    if rules.max_results is not None:
        rows = F.when(count < rules.max_results, rows)
    return links.select("url", *keep, count.alias("n_rows"), rows.alias("rows"))


def feed_links(feeds: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(url, *keep, pos, link_url)`` of all feeds, without any guard."""
    links = F.posexplode(item_links(F.col("xml"))).alias("pos", "link_url")
    return feeds.select("url", *keep, links)
