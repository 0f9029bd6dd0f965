"""Find the texts that contain all terms of an item, for many items at once.

Spark has no operator for "contains all of these words" between two tables. Comparing every item
with every text, or pairing on one common word, would grow with the product of both sides: where
all words are common, most texts that have an item's rarest word lack the others. Here the words of
each item are put in one order, the rarest first as counted in the texts, and items that begin alike
share the beginning. Texts go along these beginnings one word at a time, all texts at once, and a text
that lacks the next word stays behind: no text meets an item, or another text, that it does not share a
beginning with. Nothing is capped: there are as many rounds as the longest item has words that occur.

The small results in between (items, beginnings, texts on their way) are written out once. Spark then knows
their true size: within its broadcast limit the texts are filtered where they are and nothing of
them is shuffled; beyond it both sides are shuffled and a hot beginning is split by the join at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.operators.keyed import aggregate_per_key
from fencewatch.sources.scratch import written

_SEPARATORS = r"[^\p{L}\p{Nd}]+"


def words(text: Column) -> Column:
    """Different lower-case words of a text; NULL text has none."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS)
    return F.array_remove(F.array_distinct(split), "")


def one_letter_shorter(word: Column) -> Column:
    """The word and every way to leave out one letter.

    Two words differ by at most one letter (changed, added or left out) only if these sets meet.
    """
    places = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    shorter = F.transform(
        places,
        lambda i: F.concat(
            F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)
        ),
    )
    return F.array_distinct(F.concat(F.array(word), shorter))


def near_spellings(vocabulary: DataFrame, known: DataFrame, min_length: int = 4) -> DataFrame:
    """Words within one letter of a known word: ``(term, token)``; exact ones included.

    ``vocabulary(token)`` and ``known(term)`` hold different values each. Words shorter than
    ``min_length`` only match exactly. The pairs come from an equi-join on shortened forms, so
    there is no comparison of every word with every other.
    """

    def forms(column: str) -> Column:
        long_enough = F.length(column) >= min_length
        every = F.when(long_enough, one_letter_shorter(F.col(column)))
        return F.explode(F.coalesce(every, F.array(F.col(column)))).alias("form")

    left = vocabulary.select("token", forms("token"))
    right = known.select("term", forms("term"))
    close = F.levenshtein(F.col("term"), F.col("token"), 1) >= 0
    both_long = F.least(F.length("term"), F.length("token")) >= min_length
    pairs = left.join(right, "form").where(
        (F.col("term") == F.col("token")) | (both_long & close)
    )
    return pairs.select("term", "token").distinct()


def canonical_words(vocabulary: DataFrame, known: DataFrame, min_length: int = 4) -> DataFrame:
    """One known word for every vocabulary word that is near one: ``(token, term)``.

    The exact word wins, then the alphabetically first.
    """
    near = near_spellings(vocabulary, known, min_length)
    rank = F.struct((F.col("term") != F.col("token")).alias("changed"), F.col("term"))
    return near.groupBy("token").agg(F.min(rank).alias("best")).select("token", "best.term")


def texts_with_all_terms(
    items: DataFrame, texts: DataFrame, fuzzy_column: str | None = None, min_length: int = 4
) -> DataFrame:
    """``items(item_id, terms)`` and ``texts(text_id, text)`` to ``(item_id, text_id)`` pairs.

    As :func:`sets_in_texts`, with the ids of all items of a set. Where many items ask for the same
    words that many texts have, this is the product of both: such results are better kept as sets.
    """
    matches, members = sets_in_texts(items, texts, fuzzy_column, min_length)
    return members.join(matches, "set_id").select("item_id", "text_id")


def sets_in_texts(
    items: DataFrame, texts: DataFrame, fuzzy_column: str | None = None, min_length: int = 4
) -> tuple[DataFrame, DataFrame]:
    """``(set_id, text_id)`` of texts with all terms of a set, and ``(item_id, set_id, terms)``.

    ``items(item_id, terms)``, ``texts(text_id, text)``. A text matches when every term of the set is a
    word of it. Terms also listed in the item's ``fuzzy_column`` array may be one letter off. ``text_id``
    and ``item_id`` are unique. Items without terms match nothing. Items with the same terms are one set,
    which is matched once.
    """
    terms = F.array_sort(F.array_distinct("terms"))
    no_terms = F.array().cast("array<string>")
    fuzzy = F.array_sort(F.array_intersect(terms, F.col(fuzzy_column))) if fuzzy_column else no_terms
    keyed = items.select("item_id", terms.alias("terms"), fuzzy.alias("fuzzy_terms")).withColumn(
        "set_id", F.sha2(F.to_json(F.struct("terms", "fuzzy_terms")), 256)
    )
    keyed = written(keyed, "items")
    matched = _matches(keyed, texts, fuzzy_column is not None, min_length)
    return matched, keyed.select("item_id", "set_id", "terms")


def _matches(keyed: DataFrame, texts: DataFrame, any_fuzzy: bool, min_length: int) -> DataFrame:
    """Pairs ``(set_id, text_id)`` for each different set of terms."""
    sets = keyed.select("set_id", "terms", "fuzzy_terms").dropDuplicates(["set_id"])
    wanted = sets.select(
        "set_id",
        F.explode("terms").alias("term"),
        F.size("terms").alias("n_terms"),
        "fuzzy_terms",
    ).select(
        "set_id", "term", "n_terms", F.array_contains("fuzzy_terms", F.col("term")).alias("fuzzy")
    )
    # Texts are taken apart once; a text is known by the number of its row.
    worded = texts.where(F.col("text_id").isNotNull()).select("text_id", words(F.col("text")).alias("words"))
    worded = written(worded.withColumn("row", F.monotonically_increasing_id()), "text-words")
    tokens = worded.select("row", "text_id", F.explode("words").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count("*").alias("texts_with"))

    spellings = _spellings_in_use(wanted, frequency, any_fuzzy, min_length)
    spellings = written(spellings.withColumn("term_id", F.monotonically_increasing_id()), "spellings")
    place = F.struct("texts_with", "term_id")
    per_set = wanted.join(spellings, ["term", "fuzzy"]).groupBy("set_id").agg(
        F.sort_array(F.collect_list(place)).alias("path"),
        F.count("*").alias("n_found"),
        F.max("n_terms").alias("n_terms"),
    )
    # A set with a term that no text has cannot match.
    possible = per_set.where(F.col("n_found") == F.col("n_terms")).select("set_id", F.col("path.term_id").alias("path"))
    possible = written(possible, "possible-sets")
    beginnings = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    nodes = possible.select(F.explode(beginnings).alias("path")).distinct()
    nodes = written(nodes.withColumn("depth", F.size("path")), "set-beginnings")

    spelt = spellings.select("texts_with", "term_id", F.explode("tokens").alias("token"))
    held = tokens.join(spelt, "token").groupBy("row", "text_id").agg(F.sort_array(F.collect_set(place)).alias("held"))
    live = held.select("text_id", F.col("held.term_id").alias("held"), F.array().cast("array<bigint>").alias("path"))
    reached: DataFrame | None = None
    for depth in range(1, (nodes.select(F.max("depth")).first()[0] or 0) + 1):
        live = written(_one_term_further(live, nodes.where(F.col("depth") == depth).select("path")), "texts-at-sets")
        here = live.select("text_id", "path")
        reached = here if reached is None else reached.unionByName(here)
    if reached is None:
        reached = live.select("text_id", "path").limit(0)
    return reached.join(possible, "path").select("set_id", "text_id")


def _one_term_further(live: DataFrame, nodes: DataFrame) -> DataFrame:
    """Texts ``(text_id, held, path)``, each at every ``nodes(path)`` that is one of its terms longer; ``held`` are the terms after it."""
    grown = live.select("text_id", "held", "path", F.posexplode("held").alias("place", "term_id")).select(
        "text_id",
        F.slice("held", F.col("place") + 2, F.size("held")).alias("held"),
        F.concat("path", F.array("term_id")).alias("path"),
    )
    return grown.join(nodes, "path", "left_semi")


def _spellings_in_use(
    wanted: DataFrame, frequency: DataFrame, fuzzy: bool, min_length: int
) -> DataFrame:
    """Words of the texts that count as each term: ``(term, fuzzy, tokens, texts_with)``."""
    terms = wanted.select("term", "fuzzy").distinct()
    exact = terms.join(
        frequency.withColumnRenamed("token", "term"), "term"
    ).select("term", "fuzzy", F.col("term").alias("token"), "texts_with")
    if fuzzy:
        near = near_spellings(
            frequency.select("token"), terms.where("fuzzy").select("term"), min_length
        )
        close = near.join(frequency, "token").select(
            "term", F.lit(True).alias("fuzzy"), "token", "texts_with"
        )
        exact = exact.where(~F.col("fuzzy")).unionByName(close)
    return aggregate_per_key(
        exact,
        ["term", "fuzzy"],
        F.sort_array(F.collect_list("token")).alias("tokens"),
        F.sum("texts_with").alias("texts_with"),
    )
