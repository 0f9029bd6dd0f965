"""Column functions that read fixed markup without leaving the JVM.

They cover elements chosen by tag and class. A ``>`` inside an attribute value is
not understood, and element names inside scripts are seen as elements.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fencewatch.settings import Selector

_SCRIPT = r"(?i:script)(?=[\s/>])[^>]*>(.*?)</(?i:script)\s*>"
_STYLE = r"(?i:style)(?=[\s/>])[^>]*>(.*?)</(?i:style)\s*>"
_MARKUP = rf"(?s)<(?:{_SCRIPT}|{_STYLE}|!--.*?-->|[^>]*>)"
_FIRST_LINK = r"<(?i:a)(?=[\s/>])[^>]*>(?:[^<]++|<(?!/(?i:a)\s*>))*+(?:</(?i:a)\s*>)?"


def start_tag_pattern(selector: Selector) -> str:
    attribute = ""
    if selector.css_class is not None:
        value = re.escape(selector.css_class)
        attribute = rf"""[^>]*?\s(?i:class)\s*=\s*(?:"{value}"|'{value}'|{value}(?=[\s>]))"""
    return rf"<(?i:{selector.tag})(?=[\s/>]){attribute}[^>]*>"


def _up_to(tag: str) -> str:
    """Everything before the given tag, or all of it: runs of text are taken whole, not by char."""
    return rf"(?:[^<]++|<(?!{tag}))*+"


def element_pattern(selector: Selector) -> str:
    """The element up to its first end tag, or to the end of the text when it has none."""
    end = rf"/(?i:{selector.tag})\s*>"
    return rf"{start_tag_pattern(selector)}{_up_to(end)}(?:<{end})?"


def row_pattern(selector: Selector) -> str:
    """The element without its end tag; the next start tag of the same name ends it too."""
    tag = selector.tag
    return rf"{start_tag_pattern(selector)}{_up_to(rf'/?(?i:{tag})[\s/>]')}"


def element(html: Column, selector: Selector) -> Column:
    """First matching element with its tags, up to its first end tag; '' when there is none.

    The empty text stands for "none" so that the search is one plain expression, which can be
    computed once in a projection of its own and then used several times.
    """
    return F.regexp_extract(html, element_pattern(selector), 0)


def balanced(found: Column, html: Column, selector: Selector) -> Column:
    """An :func:`element` whose own tag may be nested, closed by the end tag that balances it."""
    if not selector.nests:
        return found
    opening = f"<{selector.tag}".lower()
    # Byte search; it passes over the element's own start tag.
    rest = F.lower(F.substr(found, F.lit(len(opening) + 1)))
    nested = F.contains(rest, F.lit(opening))
    return F.when(nested, _balanced_element(html, selector)).otherwise(found)


def _balanced_element(html: Column, selector: Selector) -> Column:
    """The element without the end tag that balances its start tag."""
    start = F.regexp_instr(html, F.lit(start_tag_pattern(selector)))
    rest = F.substr(html, start)
    pieces = F.split(rest, rf"(?=</?(?i:{selector.tag})[\s/>])")

    def step(state: Column, piece: Column) -> Column:
        change = F.when(piece.startswith("</"), -1).otherwise(1)
        depth = F.when(state["open"], state["depth"] + change).otherwise(0)
        still_open = state["open"] & (depth > 0)
        return F.struct(
            depth.cast("int").alias("depth"),
            still_open.alias("open"),
            (state["kept"] + still_open.cast("int")).alias("kept"),
        )

    begin = F.struct(
        F.lit(0).alias("depth"), F.lit(True).alias("open"), F.lit(0).alias("kept")
    )
    kept = F.aggregate(pieces, begin, step, lambda state: state["kept"])
    return F.array_join(F.slice(pieces, F.lit(1), kept), "")


def inner_text(fragment: Column) -> Column:
    """Text of a fragment: tags and comments go, script and style content stays, entities stay."""
    return F.regexp_replace(fragment, _MARKUP, "$1$2")


def text_of(found: Column) -> Column:
    """Inner text of an :func:`element`: NULL without the element, '' when it is empty."""
    return F.when(found != "", inner_text(found))


def first_link(fragment: Column) -> Column:
    """First ``a`` element of a fragment with its tags; '' when there is none."""
    return F.regexp_extract(fragment, _FIRST_LINK, 0)


def attribute_of(tag_text: Column, name: str) -> Column:
    """Value of an attribute of the first tag in a fragment, as written; NULL when absent."""
    # One group for a quoted value and one for a bare one; the mark between tells "" from none.
    pattern = rf"""(?s)^<[^>]*?\s(?i:{name})\s*=\s*(?:(["'])(.*?)\1|([^\s"'>]+)).*"""
    return F.when(F.regexp_like(tag_text, F.lit(pattern)), F.regexp_replace(tag_text, pattern, "$2$3"))


def all_links(html: Column) -> Column:
    """Every ``a`` element of a page, in page order, as an array."""
    return F.regexp_extract_all(html, F.lit(_FIRST_LINK), 0)
