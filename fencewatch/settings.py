"""Selectors, limits and names shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. Results are only comparable when these are the same everywhere.
# ---------------------------------------------------------------------------
IMAGE_POINTS = 500
IMAGE_POINTS_EACH = -50
TEXT_POINTS = 500
TEXT_POINTS_EACH = -1
PHONE_WINDOW = 12
PHONE_AREA_CODES = ("604", "708")
PHONE_DEFAULT = "12345678"
IMAGE_LIST_MARK = "imgList ="
IMAGE_ARGUMENT_SEPARATOR = "XKRXKRXKR"
IMAGE_HOST = "http://images.craigslist.org/"
SEARCH_SITE = "craigslist.ca"
HTML_PAGE_SIZE = 100
HTML_MAX_RESULTS = 50
RSS_PAGE_SIZE = 25
RSS_MAX_RESULTS = 25
TOO_MANY_TITLE = "More than {limit} results returned, please be more selective"
NO_RESULTS_TITLE = "No results returned, alter your search terms"
DEFAULT_CITY = "vancouver"
DEFAULT_PAGE = "0"

# Wire name of every listing column, in wire order.
LISTING_WIRE_NAMES = {
    "link_url": "linkURL",
    "description": "decriptionHTML",
    "date_posted": "datePosted",
    "images": "images",
    "title": "title",
    "dodgy_score": "dodgyScore",
    "date_posted_real": "datePostedReal",
    "phone_number": "phoneNumber",
    "price": "price",
    "sale_area": "saleArea",
    "short_title": "shortTitle",
    "category": "category",
    "date_posted_parsed": "datePostedParsed",
    "dodgy_description": "dodgyDescription",
}

# Characters counted as white space, Unicode ones included.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same characters as a class of the regular expressions that Spark uses.
WHITESPACE_CLASS = r"\p{IsWhite_Space}"

# Three-letter colour codes used by the property register.
COLOUR_CODES = {
    "BGE": "beige",
    "BLK": "black",
    "BLU": "blue",
    "BRN": "brown",
    "GRY": "grey",
    "RED": "red",
    "SIL": "silver",
    "WHI": "white",
    "YEL": "yellow",
    "GRN": "green",
    "ORG": "orange",
    "PLE": "purple",
    "PNK": "pink",
    "GLD": "gold",
    "CRM": "cream",
    "TAN": "tan",
    "MAR": "maroon",
}
#: What registers write for a maker nobody knows, and what stands behind makers' names.
PLACEHOLDER_MAKES = ("other", "unknown", "none", "unk")
COMPANY_SUFFIXES = ("co", "inc", "ltd", "corp", "llc")


@dataclass(frozen=True)
class Selector:
    """An element by tag name and, optionally, the exact value of its class attribute.

    ``nests`` says that the element may hold elements of the same tag; it is then
    closed by the end tag that balances its own start tag.
    """

    tag: str
    css_class: str | None = None
    nests: bool = False


@dataclass(frozen=True)
class ResultPageSelectors:
    row: Selector = Selector("p", "row")
    date: Selector = Selector("span", "itemdate")
    price: Selector = Selector("span", "itempp")
    area: Selector = Selector("font")
    category: Selector = Selector("span", "itemcg")


@dataclass(frozen=True)
class DetailPageSelectors:
    title: Selector = Selector("h2")
    time: Selector = Selector("time")
    body: Selector = Selector("section", "userbody", nests=True)


@dataclass(frozen=True)
class PhoneRule:
    """``strict`` looks for a whole ten-digit number instead of a fixed-size window."""

    area_codes: tuple[str, ...] = PHONE_AREA_CODES
    window: int = PHONE_WINDOW
    default: str = PHONE_DEFAULT
    strict: bool = False


@dataclass(frozen=True)
class SearchRules:
    """Everything that differs between the HTML and the RSS search."""

    site: str = SEARCH_SITE
    page_size: int = HTML_PAGE_SIZE
    max_results: int | None = HTML_MAX_RESULTS
    extra_query: str = ""
    empty_description: str = ""
    rows: ResultPageSelectors = field(default_factory=ResultPageSelectors)
    detail: DetailPageSelectors = field(default_factory=DetailPageSelectors)
    phone: PhoneRule = field(default_factory=PhoneRule)


HTML_SEARCH = SearchRules()
RSS_SEARCH = SearchRules(
    page_size=RSS_PAGE_SIZE,
    max_results=RSS_MAX_RESULTS,
    extra_query="&format=rss",
    empty_description="Error",
)
