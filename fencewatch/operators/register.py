"""Stolen-property register: filter, projection, colours, search terms, matching adverts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.operators.matching import sets_in_texts, texts_with_all_terms, words
from fencewatch.settings import COLOUR_CODES, COMPANY_SUFFIXES, PLACEHOLDER_MAKES

YEAR = "Report Year"
MAKE = "Manufacturer's name"
MODEL = "Model"
COLOUR = "Color"


def reported_in(register: DataFrame, year: str | int) -> DataFrame:
    return register.where(F.col(YEAR) == str(year))


def reported_since(register: DataFrame, today: Column, years: int = 1) -> DataFrame:
    """Reports of the last ``years`` calendar years; the register states a year, not a date."""
    first = F.year(today) - years
    return register.where(F.col(YEAR).try_cast("int").between(first, F.year(today)))


def make_model_colour(register: DataFrame, *keep: str) -> DataFrame:
    """The three columns that adverts are compared with."""
    return register.select(
        *keep,
        F.col(MAKE).alias("make"),
        F.col(MODEL).alias("model"),
        F.col(COLOUR).alias("color"),
    )


def colour_names(code: Column, codes: Mapping[str, str] = COLOUR_CODES) -> Column:
    """``BRNBLK`` to ``[brown, black]``; an unknown code stays, in lower case."""
    upper = F.upper(F.trim(code))
    starts = F.sequence(F.lit(1), F.greatest(F.length(upper), F.lit(1)), F.lit(3))
    chunks = F.transform(starts, lambda i: F.substr(upper, i, F.lit(3)))
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    named = F.transform(chunks, lambda c: F.coalesce(F.try_element_at(table, c), F.lower(c)))
    return F.when(F.length(upper) > 0, named)


def make_words(make: Column) -> Column:
    """Words of a maker's name that say something: no placeholder, no company suffix."""
    idle = F.array(*[F.lit(word) for word in (*PLACEHOLDER_MAKES, *COMPANY_SUFFIXES)])
    return F.array_except(words(make), idle)


def search_terms(
    make: Column, model: Column, color: Column, codes: Mapping[str, str] = COLOUR_CODES
) -> Column:
    """All words a matching advert has to contain; a colour code without a name asks for nothing."""
    known = F.array(*[F.lit(name) for name in dict.fromkeys(codes.values())])
    named = F.coalesce(colour_names(color, codes), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(make_words(make), words(model), F.array_intersect(named, known)))


def register_items(
    register: DataFrame, id_column: str, codes: Mapping[str, str] = COLOUR_CODES
) -> DataFrame:
    """Register rows as ``(item_id, terms, make_terms)`` for :func:`match_register`."""
    return make_model_colour(register, id_column).select(
        F.col(id_column).alias("item_id"),
        search_terms(F.col("make"), F.col("model"), F.col("color"), codes).alias("terms"),
        make_words(F.col("make")).alias("make_terms"),
    )


def match_register(
    items: DataFrame, listings: DataFrame, misspelt_makes: bool = True
) -> DataFrame:
    """Pairs of register items and adverts: ``(item_id, listing_id)``.

    ``listings(listing_id, text)``. An advert matches when it has all words of the item, as a
    keyword search for make, model and colour would find; makes may be one letter off.
    """
    texts = listings.select(F.col("listing_id").alias("text_id"), "text")
    fuzzy = "make_terms" if misspelt_makes else None
    return texts_with_all_terms(items, texts, fuzzy).withColumnRenamed("text_id", "listing_id")


def match_register_sets(
    items: DataFrame, listings: DataFrame, misspelt_makes: bool = True
) -> tuple[DataFrame, DataFrame]:
    """:func:`match_register` without its product: ``(set_id, listing_id)`` and ``(item_id, set_id, terms)``.

    Registers hold many items that ask for the same words; each such set of words is paired with its adverts once.
    """
    texts = listings.select(F.col("listing_id").alias("text_id"), "text")
    matches, members = sets_in_texts(items, texts, "make_terms" if misspelt_makes else None)
    return matches.withColumnRenamed("text_id", "listing_id"), members
