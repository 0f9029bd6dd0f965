"""Column functions for the parts of an advert: images, phone number, dates, price."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fencewatch.settings import IMAGE_LIST_MARK, WHITESPACE, WHITESPACE_CLASS, PhoneRule


def trim_whitespace(text: Column) -> Column:
    """Trim every kind of white space, not only the blank."""
    return F.trim(text, F.lit(WHITESPACE))


def whitespace_count(text: Column) -> Column:
    """Number of white-space characters, Unicode ones included."""
    return F.length(text) - F.length(F.regexp_replace(text, WHITESPACE_CLASS, ""))


def description(body_text: Column) -> Column:
    """Body text without tabs and line feeds; carriage returns stay."""
    return F.replace(F.replace(body_text, F.lit("\t"), F.lit("")), F.lit("\n"), F.lit(""))


def has_image_script(body_text: Column) -> Column:
    return F.contains(body_text, F.lit(IMAGE_LIST_MARK))


def image_script(body_text: Column) -> Column:
    """The image list statement of the page's script, up to its closing bracket; '' without one."""
    return F.regexp_extract(body_text, rf"{IMAGE_LIST_MARK}[^\[\]]*\[[^\]]*\]", 0)


def image_list(script: Column) -> Column:
    """Image addresses out of an :func:`image_script`.

    NULL without one. ``[]`` gives one empty string and elements are not trimmed: both are part
    of the rule.
    """
    listed = F.regexp_extract(script, r"\[([^\]]*)\]", 1)
    for dropped in ('"', "\n", "\r"):
        listed = F.replace(listed, F.lit(dropped), F.lit(""))
    return F.when(script != "", F.split(listed, ",", -1))


def phone_number(text: Column, rule: PhoneRule = PhoneRule()) -> Column:
    """Digits that follow the first known area code, or the rule's default number.

    The window is counted in UTF-16 units and a match at the very start of the text does not
    count; codes are tried in order.
    """
    if rule.strict:
        return _whole_phone_number(text, rule)
    windows = []
    for code in rule.area_codes:
        # Most adverts have no number: a byte search settles that before positions are counted.
        at = F.when(F.contains(text, F.lit(code)), F.instr(text, F.lit(code)))
        windows.append(F.when(at > 1, F.substr(text, at, F.lit(rule.window))))
    window = F.coalesce(*windows, F.lit(rule.default))
    # A character outside the basic plane takes two units and is never a digit.
    units = F.regexp_replace(window, r"[\x{10000}-\x{10FFFF}]", "--")
    digits = F.regexp_replace(F.substring(units, 1, rule.window), r"\P{Nd}", "")
    return F.when(text.isNotNull(), digits)


def _whole_phone_number(text: Column, rule: PhoneRule) -> Column:
    codes = "|".join(rule.area_codes)
    pattern = rf"(?<!\d)\(?(?:{codes})\)?[\s.\-]{{0,3}}\d{{3}}[\s.\-]{{0,3}}\d{{4}}(?!\d)"
    found = F.regexp_substr(text, F.lit(pattern))
    return F.when(
        text.isNotNull(), F.coalesce(F.regexp_replace(found, r"\D", ""), F.lit(rule.default))
    )


def posted_on(date_text: Column, year: Column | int, crawled_on: Column | None = None) -> Column:
    """Day of a year-less date such as `` Dec 11``, in any session zone; NULL when it does not parse.

    The first seven characters must be a blank, a month and a two-digit day. With
    ``crawled_on`` a date later than the crawl is taken to be of the year before.
    """
    year_column = F.lit(year) if isinstance(year, int) else year
    seven = F.when(F.length(date_text) >= 7, F.substring(date_text, 1, 7))

    def in_year(number: Column) -> Column:
        text = F.concat(F.lpad(number.cast("string"), 4, "0"), seven)
        # Read and cut in one zone, whichever it is, so that the day stays as written.
        return F.try_to_timestamp(text, F.lit("yyyy MMM dd")).cast("date")

    same_year = in_year(year_column)
    if crawled_on is None:
        return same_year
    before = in_year(year_column - 1)
    return F.when(same_year > crawled_on, before).otherwise(same_year)


def posted_text(day: Column) -> Column:
    """The day as shown, at midnight."""
    return F.concat(F.date_format(day, "dd MMM yyyy"), F.lit(" 00:00:00"))


def price_amount(price: Column) -> Column:
    """Price text such as ``$6595`` or ``$1,200.50`` as a number; NULL when there is none."""
    digits = F.regexp_substr(F.translate(price, ",", ""), F.lit(r"\d+(?:\.\d+)?"))
    return digits.try_cast("decimal(18,2)")
