"""The best adverts for each register item: a top-k join on weighted words, with score bounds.

An advert can be an item's if it names the item's make, one letter off at most; its score is the weight of
the item's model and colour words that it has, rarer words weighing more. Holding every item against
every advert of its make would grow with the product of both, so the join works on what differs and stops where
nothing better can come:

* items with the same words are one term set, adverts with the same words that any item asks for are one
  signature, of which the k first adverts are enough;
* a set's words are ordered by weight. Signatures with its heaviest word come first and give the k-th
  best score so far. An advert that has none of the heavier words cannot score more than the sum of the lighter ones:
  words whose sum falls below that score need no candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fencewatch.operators.matching import near_spellings, words
from fencewatch.sources.scratch import written


def _digest(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def _signatures(listings: DataFrame, terms: DataFrame, makes: DataFrame, k: int, min_length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sig_id, makes, words) of different adverts, (sig_id, listing_id) of the k first of each, (term, weight)."""
    tokens = listings.select("listing_id", F.explode_outer(words(F.col("text"))).alias("token"))
    tokens = written(tokens.distinct(), "advert-words")
    vocabulary = tokens.select("token").where("token IS NOT NULL").distinct()
    spelt = near_spellings(vocabulary, makes.select("term"), min_length).withColumnRenamed("term", "make")
    n = tokens.select(F.count_distinct("listing_id")).scalar()
    held = tokens.join(terms.select(F.col("term").alias("token")), "token")
    frequency = held.groupBy("token").agg(F.count("*").alias("adverts"))
    weight = F.floor(F.lit(1000) * F.ln((n + 1) / (F.col("adverts") + 1))).cast("long") + 1
    weights = written(frequency.select(F.col("token").alias("term"), weight.alias("weight")), "term-weights")

    named = tokens.join(spelt, "token").groupBy("listing_id").agg(F.sort_array(F.collect_set("make")).alias("makes"))
    asked = held.groupBy("listing_id").agg(F.sort_array(F.collect_set("token")).alias("words"))
    described = named.join(asked, "listing_id").withColumn("sig_id", _digest("makes", "words"))
    first = Window.partitionBy("sig_id").orderBy("listing_id")
    kept = written(described.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k), "signature-adverts")
    return kept.where("place = 1").select("sig_id", "makes", "words"), kept.select("sig_id", "listing_id"), weights


def _term_sets(items: DataFrame, weights: DataFrame) -> DataFrame:
    """(set_id, make_terms, ordered): words in some advert, the heaviest first, each with the sum from it on."""
    sets = items.select("set_id", "make_terms", "terms").dropDuplicates(["set_id"])
    weighed = sets.select("set_id", F.explode("terms").alias("term")).join(weights, "term")
    entry = F.struct((-F.col("weight")).alias("less"), "term", "weight")
    lists = weighed.groupBy("set_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    rest = F.transform(
        "entries",
        lambda e, i: F.struct(
            e["term"].alias("term"),
            e["weight"].alias("weight"),
            F.aggregate(F.slice("entries", i + 1, F.size("entries")), F.lit(0).cast("long"), lambda t, x: t + x["weight"]).alias("most"),
        ),
    )
    return sets.select("set_id", "make_terms").join(lists, "set_id").select("set_id", "make_terms", rest.alias("ordered"))


def _scored(sets: DataFrame, signatures: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, sig_id, score) of candidate pairs whose makes agree."""
    joined = pairs.join(sets, "set_id").join(signatures, "sig_id")
    agree = F.size(F.array_except("make_terms", "makes")) == 0
    found = F.filter("ordered", lambda e: F.array_contains("words", e["term"]))
    score = F.aggregate(found, F.lit(0).cast("long"), lambda total, e: total + e["weight"])
    return joined.where(agree).select("set_id", "sig_id", score.alias("score"))


def _best(scored: DataFrame, adverts: DataFrame, k: int) -> DataFrame:
    """(set_id, rank, listing_id, score), the k best of each set, equal scores by listing_id."""
    # k signatures hold k adverts at least; more of them count only where scores are equal.
    least = Window.partitionBy("set_id").orderBy(F.col("score").desc())
    close = scored.withColumn("level", F.rank().over(least)).where(F.col("level") <= k).drop("level")
    order = Window.partitionBy("set_id").orderBy(F.col("score").desc(), "listing_id")
    ranked = close.join(adverts, "sig_id").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("set_id", "rank", "listing_id", "score")


def ranked_adverts(
    items: DataFrame, listings: DataFrame, k: int = 5, min_length: int = 4
) -> tuple[DataFrame, DataFrame]:
    """``(set_id, rank, listing_id, score)`` of the k best adverts of each term set, and ``(item_id, set_id)``.

    ``items(item_id, terms, make_terms)`` as ``register_items`` makes them; words of the make are not
    scored. ``listings(listing_id, text)`` with unique ids. Items without make words, and adverts without
    any word of the item, are not matched. A word weighs 1 + floor(1000 ln((adverts + 1) / (adverts with it + 1))).
    """
    scored_terms = F.array_sort(F.array_distinct(F.array_except("terms", "make_terms")))
    keyed = items.where(F.size("make_terms") > 0).select(
        "item_id", F.array_sort(F.array_distinct("make_terms")).alias("make_terms"), scored_terms.alias("terms")
    )
    keyed = written(keyed.withColumn("set_id", _digest("make_terms", "terms")), "ranked-items")
    terms = keyed.select(F.explode("terms").alias("term")).distinct()
    makes = keyed.select(F.explode("make_terms").alias("term")).distinct()
    signatures, adverts, weights = _signatures(listings, terms, makes, k, min_length)
    sets = written(_term_sets(keyed, weights), "term-sets")
    makes_of = F.array_min("make_terms").alias("make")  # all make words are checked later; one finds the candidates
    index = signatures.select("sig_id", F.explode("makes").alias("make"), "words").select(
        "sig_id", "make", F.explode("words").alias("term")
    )
    index = written(index, "signature-words")

    heaviest = sets.select("set_id", makes_of, F.col("ordered")[0]["term"].alias("term"))
    first = written(_scored(sets, signatures, heaviest.join(index, ["make", "term"]).select("set_id", "sig_id")), "first-scores")
    reached = _best(first, adverts, k).where(F.col("rank") == k).select("set_id", F.col("score").alias("reached"))
    lighter = F.explode(F.filter(F.slice("ordered", 2, F.size("ordered")), lambda e: e["most"] >= F.coalesce("reached", F.lit(0)))["term"])
    needed = sets.join(reached, "set_id", "left").where(F.size("ordered") > 1).select("set_id", makes_of, lighter.alias("term"))
    more = needed.join(index, ["make", "term"]).select("set_id", "sig_id").distinct()
    more = more.join(first.select("set_id", "sig_id"), ["set_id", "sig_id"], "left_anti")
    every = written(first.unionByName(_scored(sets, signatures, more)), "scores")
    return _best(every, adverts, k), keyed.select("item_id", "set_id")
