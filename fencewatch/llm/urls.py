"""URL filters: explicit host and path rules, and association rules that FP-growth mines from labels.

Everything here is DataFrame functions; nothing runs in Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.sources.scratch import written

BLOCK, ALLOW = "block", "allow"
_BAD = "label:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Mining:
    """A rule needs this share of all labelled URLs and this many of them, this confidence, and this much more of it than a
    shorter rule has."""

    support: float = 0.002
    least: int = 10
    confidence: float = 0.5
    gain: float = 0.05


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def listed_rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest listed rule that fits, or null; the list is a short parameter.

    A rule is ``host/path``; it fits its host and all subdomains where the URL's path starts with its
    own path.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    options = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((host_ == name) | F.endswith(host_, F.lit("." + name))) & F.startswith(path_, F.lit(slash + rest))
        entry = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        options.append(F.when(fits, entry))
    return F.array_max(F.array_compact(F.array(*options)))


def items(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, host labels, words of path and query. Numbers say nothing."""
    name, place = host(url), path(url)
    query = F.regexp_extract(url, r"[?#](.*)$", 1)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)

    def named(kind: str, words: Column) -> Column:
        return F.transform(words, lambda w: F.concat(F.lit(kind + ":"), w))

    def words(text: Column, part: str) -> Column:
        return F.filter(F.split(F.lower(text), part), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))

    return F.array_distinct(
        F.concat(
            named("scheme", F.filter(F.array(F.lower(scheme)), lambda w: w != "")),
            named("host", words(name, r"[.]")),
            named("part", F.flatten(F.transform(F.filter(words(name, r"[.]"), lambda w: F.contains(w, F.lit("-"))), lambda w: words(w, "-")))),
            named("path", words(place, r"[/._-]")),
            named("query", words(query, r"[&#=]")),
        )
    )


def _baskets(labelled: DataFrame) -> DataFrame:
    """(url, items, bad) of the different labelled URLs; one with both labels is bad."""
    known = labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull())
    return known.groupBy("url").agg(F.max("bad").alias("bad")).withColumn("items", items(F.col("url"))).where(F.size("items") > 0)


def _twins(baskets: DataFrame) -> DataFrame:
    """(token, key): tokens that the same URLs have, by one of them each.

    A family of equal long URLs would otherwise make every subset of its tokens a frequent combination. URLs
    are told apart by two 64-bit sums of their hashes.
    """
    tokens = baskets.select("url", F.explode("items").alias("token"))
    marks = tokens.groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("url")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "url")).alias("y")
    )
    first = marks.groupBy("n", "x", "y").agg(F.min("token").alias("key"))
    return written(marks.join(first, ["n", "x", "y"]).select("token", "key", F.col("n").alias("freq")), "url-tokens")


def mined_rules(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(antecedent, key, confidence, support) of token combinations whose URLs are mostly bad.

    ``labelled`` has url and bad (boolean); repeated URLs count once. FP-growth finds the frequent combinations; rules
    below the support or confidence are dropped, and so is a rule that contains a shorter one of nearly the same
    confidence. Support bounds the number of rules whatever the size of the input, the least count that of a
    small one. Tokens that always come together are mined as one: each is a rule by itself where the one is, and
    longer combinations have the one that stands for them. ``key`` is the token by which the inverted index
    finds the rule: its rarest.
    """
    spark = labelled.sparkSession
    baskets = written(_baskets(labelled), "url-baskets")
    n = baskets.count()
    none = "antecedent array<string>, key string, confidence double, support double"
    if n < mining.least:
        return spark.createDataFrame([], none)
    support = max(mining.support, mining.least / n)
    twins = _twins(baskets)
    common = twins.where((F.col("token") == F.col("key")) & (F.col("freq") >= F.lit(support * n)))
    mined = (
        baskets.select("url", "bad", F.explode("items").alias("key"))
        .join(common.select("key"), "key", "left_semi")
        .groupBy("url", "bad")
        .agg(F.collect_list("key").alias("items"))
        .select(F.concat("items", F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    )
    mined = written(mined, "mined-baskets")
    if mined.isEmpty():
        return spark.createDataFrame([], none)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Baskets without a common token are left out, so that the share is of those that are left.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support * n / mined.count()), numPartitions=parts).fit(mined)
    sets = written(model.freqItemsets.select(F.sort_array("items").alias("items"), "freq"), "url-itemsets")
    bad = sets.where(F.array_contains("items", _BAD) & (F.size("items") > 1)).select(
        F.array_remove("items", _BAD).alias("antecedent"), F.col("freq").alias("bad")
    )
    rules = bad.join(sets.withColumnRenamed("items", "antecedent"), "antecedent").select(
        "antecedent", (F.col("bad") / F.col("freq")).alias("confidence"), (F.col("bad") / F.lit(n)).alias("support")
    )
    keyed = (
        rules.where(F.col("confidence") >= mining.confidence)
        .select("*", F.explode("antecedent").alias("key"))
        .join(common.select("key", "freq"), "key")
        .groupBy("antecedent", "confidence", "support")
        .agg(F.min(F.struct("freq", "key"))["key"].alias("key"))
    )
    keyed = written(keyed, "url-rules")
    # A shorter rule inside a longer one is found under one of the longer one's tokens.
    longer = keyed.select(F.col("antecedent").alias("longer"), F.col("confidence").alias("c"), F.explode("antecedent").alias("key"))
    idle = longer.join(keyed.select("antecedent", "confidence", "key"), "key").where(
        (F.size("antecedent") < F.size("longer"))
        & (F.size(F.array_except("antecedent", "longer")) == 0)
        & (F.col("c") < F.col("confidence") + mining.gain)
    )
    kept = keyed.join(idle.select(F.col("longer").alias("antecedent")).distinct(), "antecedent", "left_anti")
    single = kept.where(F.size("antecedent") == 1).join(twins.select("key", "token"), "key")
    alone = single.select(F.array("token").alias("antecedent"), F.col("token").alias("key"), "confidence", "support")
    return written(kept.where(F.size("antecedent") > 1).select(alone.columns).unionByName(alone), "url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct URLs that some mined rule fits, with the best rule's confidence.

    Each rule is listed under its rarest token; a URL meets only the rules under its own tokens.
    """
    tokens = urls.where(F.col("url").isNotNull()).select("url").distinct().withColumn("items", items(F.col("url")))
    return (
        tokens.select("url", "items", F.explode("items").alias("key"))
        .join(rules, "key")
        .where(F.size(F.array_except("antecedent", "items")) == 0)
        .groupBy("url")
        .agg(F.max("confidence").alias("confidence"))
    )


def judged(
    pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], mining: Mining = Mining(), key: str = "page_id"
) -> DataFrame:
    """(key, host, path, rule, verdict) of every row.

    The longest listed rule decides; where none fits, a URL that a mined rule fits is blocked and any
    other allowed. A null URL, or one without ``://``, has empty host and path and is allowed.
    Repeated rows stay and get equal verdicts; without labelled rows nothing is mined. Other columns
    are not read.
    """
    url = F.col("url")
    rows = pages.select(F.col(key), url, host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumn("_listed", listed_rule(F.col("host"), F.col("path"), rules))
    open_ = rows.where(F.col("_listed").isNull())
    hit = matched(open_, mined_rules(labelled, mining)).select("url", F.lit(True).alias("_hit"))
    return rows.join(hit, "url", "left").select(
        key,
        "host",
        "path",
        F.col("_listed.rule").alias("rule"),
        F.coalesce(F.col("_listed.verdict"), F.when(F.col("_hit"), BLOCK).otherwise(ALLOW)).alias("verdict"),
    )


def labelled_by_document(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs with the label of the document whose number they carry in their path: bad if of low quality or toxic."""
    number = F.regexp_extract(path(F.col("url")), r"/([0-9]{1,18})(?![0-9])", 1)
    numbered = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where(F.col("doc_id").isNotNull())
    bad = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return numbered.join(bad, "doc_id").select("url", "bad")
