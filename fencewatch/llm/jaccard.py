"""Near duplicates by an exact Jaccard join on word n-grams, with prefix trees.

All n-grams have one order: those that many texts of the corpus have, all of them counted, come last, the others go by
their hash. Alike sets must share some n-grams among the first of that order (the prefix), so only
prefixes are exchanged, and of these only n-grams that several sets have: a bitmap of them, sized by
their number, is applied before anything else is moved. Sets that share fewer prefix n-grams than alike sets
must are out. A short parity bitmap of each set bounds from above what two sets can share. What is left meets
in prefix trees: a unit holds the sets around one of them, in the same order with frequent n-grams first, and all its
sets are searched in its tree, sharing the overlap of common beginnings and leaving a subtree once the remaining
lengths cannot suffice. Two rounds keep hot groups linear: first every text is held against two fixed
ones of its group. Then the groups whose texts are not all joined yet are put together where they have texts in
common, and each such cluster meets in trees as a whole, in pairs of blocks where it is large: every set is
moved once, or once for each block. Only clusters of very many blocks are gone through group by group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fencewatch.llm.common import filtered_by, flat_text, key_filter, mix, perhaps_there, span_hashes, steps, word_bounds
from fencewatch.llm.trie import links
from fencewatch.operators.keyed import aggregate_per_key
from fencewatch.sources.scratch import written

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: 64-bit words of a set's parity bitmap, for small sets.
_WORDS = 16


@dataclass(frozen=True)
class JaccardRule:
    """``percent`` of the union must be shared. N-grams that ``frequent`` of every ``sample`` texts have, and ``frequent`` at least, are
    ordered last. Alike sets share ``overlap`` n-grams of their prefixes, and one more for each ``share`` n-grams
    of the smaller set. ``unit`` is how many n-grams one tree holds. A cluster of more than ``blocks`` halves of
    that is gone through group by group, ``block`` sets of a group together.
    """

    words: int = 5
    percent: int = 80
    sample: int = 32_000
    frequent: int = 3
    unit: int = 400_000
    block: int = 2_000
    overlap: int = 12
    share: int = 16
    blocks: int = 32


def shingles(column: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word n-grams of each text, sorted, and where each text's begin.

    A text of fewer words is one n-gram as a whole; one without words has none.
    """
    data, offsets = flat_text(column)
    data = _LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    keys = span_hashes(data, starts, ends)
    counts = np.diff(first)
    grams = np.where(counts > 0, np.maximum(1, counts - words + 1), 0)
    owner = np.repeat(np.arange(len(counts)), grams)
    at = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
    width = np.minimum(counts[owner], words)
    value = np.zeros(len(at), np.uint64)
    for k in reversed(range(words)):
        inside = k < width
        value[inside] = mix(value[inside] * _FACTOR + keys[at[inside] + k])
    value ^= width.astype(np.uint64)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    once = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])) if len(value) else np.zeros(0, bool)
    return value[once], np.searchsorted(owner[once], np.arange(len(counts) + 1))


@dataclass(frozen=True)
class Frequencies:
    """How many texts have each frequent n-gram among their lowest; all others count as not met."""

    numbers: np.ndarray
    counts: np.ndarray

    def __call__(self, values: np.ndarray) -> np.ndarray:
        if not len(self.numbers):
            return np.zeros(len(values), np.int64)
        at = np.minimum(np.searchsorted(self.numbers, values), len(self.numbers) - 1)
        return np.where(self.numbers[at] == values, self.counts[at], 0)


def frequencies(documents: DataFrame, rule: JaccardRule = JaccardRule()) -> Frequencies:
    """N-grams that many texts have: a share of all texts, so that their number does not grow with the corpus.

    Every text is counted, with the n-grams that its prefix can take: half as many again as it has places, lowest hashes
    first; a text of few n-grams with all. An n-gram that a fixed share of a corpus has is found at every size; one in a
    fixed number of texts makes groups of fixed size. Only the order of the n-grams comes from the counts, so that
    they never change a result.
    """
    least = max(rule.frequent, -(-documents.count() * rule.frequent // rule.sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            values, bounds = shingles(batch.column(0), rule.words)
            sizes = np.diff(bounds)
            places = np.minimum(sizes, 3 * prefix_size(sizes, rule) // 2)
            within = np.arange(len(values)) - np.repeat(bounds[:-1], sizes) < np.repeat(places, sizes)
            values, n = np.unique(values[within], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(values)), pa.array(n)], ["token", "n"])

    stated = documents.where(F.col("text").isNotNull()).select("text")
    counted = stated.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= least).toPandas()
    numbers = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(numbers)
    return Frequencies(numbers[order], rows["n"].to_numpy(np.int64)[order])


def _overlap(sizes, rule: JaccardRule):
    return rule.overlap + sizes // rule.share


def prefix_size(sizes: np.ndarray, rule: JaccardRule) -> np.ndarray:
    """How many first n-grams of a set are enough to share as many as the rule says (or all it has to) with every alike set."""
    return np.minimum(sizes, sizes - -(-sizes * rule.percent // 100) + _overlap(sizes, rule))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _classes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit mark of each whole set; 0 for an empty one."""
    sizes = np.diff(bounds)
    sums = np.append(np.uint64(0), np.cumsum(mix(values + _FACTOR), dtype=np.uint64))
    marks = mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ mix(sizes.astype(np.uint64)))
    return _signed(np.where(sizes > 0, marks, np.uint64(0)))


def _bitmap_words(sizes: np.ndarray) -> np.ndarray:
    """Words of the bitmaps of sets of these sizes: about as many bits as n-grams, a power of two."""
    return np.maximum(_WORDS, 1 << np.ceil(np.log2(np.maximum(sizes, 1) / 64)).astype(np.int64).clip(0))


def _bitmaps(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set a bitmap in which every n-gram turns one bit over: all words, and where each set's begin.

    Two bitmaps of one size differ in no more bits than their sets differ in n-grams.
    """
    sizes = np.diff(bounds)
    words = _bitmap_words(sizes)
    first = np.append(0, np.cumsum(words))
    spread = mix(values ^ _FACTOR)
    out = np.zeros(first[-1], np.uint64)
    place = (spread & np.repeat(words - 1, sizes).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(out, np.repeat(first[:-1], sizes) + place, np.uint64(1) << (spread >> np.uint64(58)))
    return out, first


def _folded(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """(sets, width): the bitmaps that smaller ones of the same sets would be."""
    sizes = np.diff(first)
    out = np.zeros((len(sizes), width), np.uint64)
    for size in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == size)
        part = words[first[some][:, None] + np.arange(size)[None, :]]
        out[some] = np.bitwise_xor.reduce(part.reshape(len(some), size // width, width), axis=1)
    return out


def described(documents: DataFrame, frequent: Frequencies, rule: JaccardRule = JaccardRule()) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class_id, prefix, bitmap) of every row; rows with equal sets have one class_id, empty sets 0."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            values, bounds = shingles(batch.column(1), rule.words)
            sizes = np.diff(bounds)
            first = np.where(sizes > 0, prefix_size(sizes, rule), 0)
            # Values are sorted within their set: only the frequent ones move, behind the others.
            met = shared.value(values)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.arange(len(values))
            moved = np.unique(owner[met > 0])
            some = np.flatnonzero(np.isin(owner, moved))
            order[some] = some[np.lexsort((values[some], met[some], owner[some]))]
            chosen = order[np.arange(len(values)) - np.repeat(bounds[:-1], sizes) < np.repeat(first, sizes)]
            prefix = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(first)), pa.int32()), pa.array(_signed(values[chosen]))
            )
            bits, bits_at = _bitmaps(values, bounds)
            bitmap = pa.ListArray.from_arrays(pa.array(bits_at, pa.int32()), pa.array(_signed(bits)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(_classes(values, bounds)), prefix, bitmap],
                ["doc_id", "text_hash", "n_shingles", "class_id", "prefix", "bitmap"],
            )

    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, class_id long, prefix array<long>, bitmap array<long>"
    )


def _shared_tokens(full: DataFrame) -> DataFrame:
    """(token, class_id, n, low, high): the prefix n-grams that several classes have, with the least and greatest of these."""
    tokens = full.select(F.explode("prefix").alias("token"), "class_id")
    groups = tokens.groupBy("token").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"))
    repeated = written(groups.where("low <> high"), "repeated-tokens")
    bitmap = full.sparkSession.sparkContext.broadcast(key_filter(repeated.select("token")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            there = np.flatnonzero(perhaps_there(bitmap.value, flat))
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes)[there])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[there]), batch.column(0).take(owner), batch.column(1).take(owner)], ["token", "class_id", "n"]
            )

    rows = full.select("class_id", F.col("n_shingles").alias("n"), "prefix").mapInArrow(run, "token long, class_id long, n long")
    return written(rows.distinct().join(repeated, "token"), "shared")


def _linked(units: DataFrame, texts: DataFrame, frequent: Frequencies, rule: JaccardRule) -> DataFrame:
    """(a, b) found in units (unit, class_id, label): all sets of a unit are searched in one tree of them.

    Texts are moved rather than sets, which are twice as large.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def solve(held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        rows = pa.Table.from_batches(held).combine_chunks()
        values, bounds = shingles(rows.column("text"), rule.words)
        ids, labels = rows.column("class_id").to_pylist(), rows.column("label").to_pylist()
        sets = [(i, label, values[a:b]) for i, label, a, b in zip(ids, labels, bounds[:-1], bounds[1:]) if a < b]
        return links(sets, sets, rule.percent, shared.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            out = []
            for low, high in zip(cuts[:-1], cuts[1:]):
                if held and unit[low] != last:
                    out += solve(held)
                    held = []
                last = unit[low]
                held.append(batch.slice(low, high - low))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        if held and (out := solve(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    rows = units.join(texts, "class_id").select("unit", "class_id", "label", "text")
    return rows.repartition("unit").sortWithinPartitions("unit", "class_id").mapInArrow(run, "a long, b long")


def _cored(held: DataFrame, rule: JaccardRule, rounds: int = 1) -> DataFrame:
    """Less of (token, class_id, n, low, high), without losing a link.

    An alike set, which may be smaller, shares the rule's number of prefix n-grams, or all that it has to share where
    that is less. So a class that shares fewer has no link, and an n-gram that only such classes share joins nothing.
    """
    smaller = F.ceil(F.col("n") * rule.percent / 100)
    for _ in range(rounds):
        least = F.least(F.lit(rule.overlap) + F.floor(smaller / rule.share), smaller)
        able = held.groupBy("class_id").agg(F.count("*").alias("shared"), F.max("n").alias("n")).where(F.col("shared") >= least)
        left = held.select("token", "class_id", "n").join(able.select("class_id"), "class_id", "left_semi")
        groups = left.groupBy("token").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"))
        held = written(left.join(groups.where("low <> high"), "token"), "shared")
    return held


def _thinned(held: DataFrame, rule: JaccardRule) -> DataFrame:
    """Less of (token, class_id, n, low, high): each class without those of its n-grams that most others share.

    Alike sets share at least L prefix n-grams, L being the lower of the rule's number and what they have to share. If
    each leaves out fewer than half of L, one is left that both have. What is left out is in the largest groups: the n-grams
    of passages that otherwise unlike texts have in common.
    """
    sizes = aggregate_per_key(held, ["token"], F.count("*").alias("size"))
    smaller = F.ceil(F.col("n") * rule.percent / 100)
    least = F.least(F.lit(rule.overlap) + F.floor(smaller / rule.share), smaller)
    order = Window.partitionBy("class_id").orderBy(F.col("size").desc(), "token")
    ranked = held.select("token", "class_id", "n").join(sizes, "token").withColumn("rank", F.row_number().over(order))
    left = written(ranked.where(F.col("rank") > F.floor((least - 1) / 2)).select("token", "class_id", "n"), "thinned")
    groups = aggregate_per_key(left, ["token"], F.min("class_id").alias("low"), F.max("class_id").alias("high"))
    return written(left.join(groups.where("low <> high"), "token"), "shared")


def _able(percent: int, a: str, b: str):
    """Whether sets of these sizes and bitmaps can be alike: an upper bound, never wrong about alike ones."""
    size, other = F.col(f"{a}_n"), F.col(f"{b}_n")
    turned = F.zip_with(f"{a}_bitmap", f"{b}_bitmap", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(turned, F.lit(0), lambda total, x: total + x)
    sized = (100 + percent) * F.least(size, other) >= percent * (size + other)
    unlike = F.size(f"{a}_bitmap") != F.size(f"{b}_bitmap")  # of different sizes: no bound
    return sized & (unlike | ((100 + percent) * (size + other - differ) >= 2 * percent * (size + other)))


def _pivot_pairs(held: DataFrame, classes: DataFrame, rule: JaccardRule) -> DataFrame:
    """(a, b): each class with the two fixed ones of each of its groups, if they can be alike."""
    met = held.select(F.col("class_id").alias("b"), F.explode(F.array("low", "high")).alias("a")).where("a <> b").distinct()
    for name in ("a", "b"):
        met = met.join(
            classes.select(F.col("class_id").alias(name), F.col("n").alias(f"{name}_n"), F.col("bitmap").alias(f"{name}_bitmap")), name
        )
    return met.where(_able(rule.percent, "a", "b")).select("a", "b")


def _open_groups(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, class_id) of the groups that are not joined yet: classes of several labels.

    The two fixed classes of a group have been held against all others of it, and are left out.
    """
    others = held.where("class_id <> low AND class_id <> high").select("token", "class_id")
    labelled = others.join(labels, "class_id")
    groups = aggregate_per_key(labelled, ["token"], F.min("label").alias("least"), F.max("label").alias("most"))
    return written(others.join(groups.where("least <> most").select("token"), "token"), "open-groups")


def _cluster_units(open_: DataFrame, classes: DataFrame, rule: JaccardRule) -> tuple[DataFrame, DataFrame]:
    """(unit, class_id) of clusters of open groups with classes in common, and (class_id) of those of too many blocks."""
    first = aggregate_per_key(open_, ["token"], F.min("class_id").alias("b"))
    edges = open_.join(first, "token").where("class_id <> b").select(F.col("class_id").alias("a"), "b")
    nodes = open_.select("class_id").distinct()
    clusters = components(edges, nodes.select("class_id", F.col("class_id").alias("label")))
    sized = clusters.join(classes.select("class_id", "n"), "class_id")
    total = aggregate_per_key(sized, ["label"], F.sum("n").alias("total"))
    blocks = F.when(F.col("total") <= rule.unit, 1).otherwise(F.ceil(F.col("total") * 2 / rule.unit)).alias("blocks")
    placed = written(sized.join(total.select("label", blocks), "label").select("class_id", "label", "blocks"), "clusters")
    small = placed.where(F.col("blocks") <= rule.blocks)
    own = F.pmod(F.xxhash64("class_id"), F.col("blocks")).alias("own")
    spread = small.select("class_id", "label", own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    unit = F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("unit")
    return spread.select(unit, "class_id"), placed.where(F.col("blocks") > rule.blocks).select("class_id")


def _all_pairs(open_: DataFrame, classes: DataFrame, labels: DataFrame, rule: JaccardRule) -> DataFrame:
    """(a, b): all classes of the same open group which have two labels and can be alike.

    A set of n n-grams can be alike to one of n * 100 / percent at most, so bands of that width are
    held against themselves and the next wider one, in pairs of blocks. The pairs of a block are only
    counted out inside its task; what leaves it has passed the bound.
    """
    rest = open_.join(labels, "class_id").join(classes.select("class_id", "n"), "class_id")
    rest = rest.withColumn("band", F.floor(F.log("n") / math.log(100 / rule.percent) + F.lit(1e-9)))
    # Each class is asked for in its own band and, as a wider one, in the band below.
    asked = rest.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band")))).withColumn("probe", F.lit(True))
    together = asked.unionByName(rest.withColumn("probe", F.lit(False)))
    sums = together.groupBy("token", "band").agg(
        F.ceil(F.greatest(F.sum(F.when(~F.col("probe"), 1)), F.lit(1)) / rule.block).alias("rows"),
        F.ceil(F.greatest(F.sum(F.when(F.col("probe"), 1)), F.lit(1)) / rule.block).alias("probes"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.bool_or(~F.col("probe")).alias("any"),
    )
    parts = together.join(sums.where("low <> high AND any"), ["token", "band"])
    mine = F.pmod(F.xxhash64("class_id"), F.when(F.col("probe"), F.col("probes")).otherwise(F.col("rows")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("probe"), F.col("rows")).otherwise(F.col("probes")) - 1))
    spread = parts.select("token", "band", "probe", "class_id", "label", "n", mine.alias("mine"), other.alias("other"))
    first, second = (F.when(F.col("probe") == p, F.col("other")).otherwise(F.col("mine")) for p in (True, False))
    units = spread.select(
        F.xxhash64("token", "band", first, second).alias("unit"), "probe", "class_id", "label", "n"
    )
    units = units.join(classes.select("class_id", "bitmap"), "class_id").select("unit", "probe", "class_id", "label", "n", "bitmap")
    percent = rule.percent

    def solve(ids, labels_, sizes, bits, probe) -> tuple[np.ndarray, np.ndarray]:
        rows, asked_ = np.flatnonzero(~probe), np.flatnonzero(probe)
        a, b = [], []
        for at in range(0, len(asked_), 64):
            some = asked_[at : at + 64]
            differ = np.bitwise_count(bits[some][:, None, :] ^ bits[rows][None, :, :]).sum(2, dtype=np.int64)
            both = sizes[some][:, None] + sizes[rows][None, :]
            able = (100 + percent) * (both - differ) >= 2 * percent * both
            able &= (100 + percent) * np.minimum(sizes[some][:, None], sizes[rows][None, :]) >= percent * both
            able &= labels_[some][:, None] != labels_[rows][None, :]
            i, j = np.nonzero(able)
            a.append(ids[some[i]])
            b.append(ids[rows[j]])
        return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_: list[tuple] = []

        def flush() -> pa.RecordBatch | None:
            _, ids, label, n, probe, bits, widths = (np.concatenate(c) for c in zip(*held_))
            held_.clear()
            a, b = solve(ids, label, n, _folded(bits, np.append(0, np.cumsum(widths)), int(widths.min())), probe)
            turn = a > b
            a, b = np.where(turn, b, a), np.where(turn, a, b)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

        for batch in batches:
            unit, ids, label, n = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
            probe = batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(5)
            bits, bits_at = lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                if held_ and held_[-1][0][0] != unit[start] and (out := flush()) is not None:
                    yield out
                own = bits[bits_at[start] : bits_at[end]]
                held_.append((*(c[start:end] for c in (unit, ids, label, n, probe)), own, np.diff(bits_at[start : end + 1])))
        if held_ and (out := flush()) is not None:
            yield out

    ordered = units.repartition("unit").sortWithinPartitions("unit")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _texts_of(wanted: DataFrame, known: DataFrame, documents: DataFrame) -> DataFrame:
    """(class_id, text) of the classes (class_id): one document of each class stands for it.

    Its text is read again rather than its set kept for all; a bitmap sized by the number of these documents
    keeps most others from being moved.
    """
    chosen = known.join(wanted, "class_id", "left_semi").groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    chosen = written(chosen.select("class_id", F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("hash")), "chosen")
    sources = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sources = filtered_by(sources, key_filter(chosen.select("hash")), "text_hash", there=True).dropDuplicates(["doc_id", "text_hash"])
    texts = sources.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("class_id", "text")
    return written(texts, "class-texts")


def _pair_units(pairs: DataFrame, classes: DataFrame, rule: JaccardRule) -> DataFrame:
    """(unit, class_id) of pairs (a, b): an a with its b, in blocks of a bounded number of n-grams."""
    sized = pairs.join(classes.select(F.col("class_id").alias("b"), "n"), "b")
    totals = sized.groupBy("a").agg(F.ceil(F.sum("n") / rule.unit).alias("blocks"))
    blocked = sized.join(totals, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")))
    unit = F.xxhash64("a", "block").alias("unit")
    return blocked.select(unit, F.col("b").alias("class_id")).unionByName(
        blocked.select("a", "block").distinct().select(unit, F.col("a").alias("class_id"))
    )


def _links(
    units: DataFrame, labels: DataFrame | None, known: DataFrame, documents: DataFrame, frequent: Frequencies, rule: JaccardRule
) -> DataFrame:
    """Links (a, b) that join what is alike within the units (unit, class_id)."""
    units = written(units, "units")
    texts = _texts_of(units.select("class_id").distinct(), known, documents)
    members = units.withColumn("label", F.col("class_id")) if labels is None else units.join(labels, "class_id")
    return written(_linked(members, texts, frequent, rule).distinct(), "links")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(class_id, label): the same label for all nodes that edges (a, b) join; nodes has class_id and label.

    Rounds take the smallest label among a node, its neighbours and its own label's node, until none
    changes. Each round is written, so a lost executor costs one round at most.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = written(nodes, "labels")
    while True:
        near = both.join(now.select(F.col("class_id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = now.join(near, now["class_id"] == near["a"], "left").select(
            "class_id", "label", F.least("label", F.coalesce("near", "label")).alias("next")
        )
        heads = step.select(F.col("class_id").alias("head"), F.col("next").alias("jump"))
        jumped = step.join(heads, F.col("next") == F.col("head"), "left").select(
            "class_id", F.col("label").alias("was"), F.least("next", F.coalesce("jump", "next")).alias("label")
        )
        done = written(jumped, "labels")
        now = done.select("class_id", "label")
        if done.where("label <> was").isEmpty():
            return now


def near_duplicates(documents: DataFrame, rule: JaccardRule = JaccardRule()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of documents (doc_id, text).

    Two texts link when their distinct n-grams (A-Z in lower case) share ``percent`` of their union;
    component_id is the smallest doc_id that links reach. A null, empty or blank text has no n-gram,
    links with nothing and is its own component. Repeated rows stay and belong together; a row with
    a null id keeps it and takes its component's. N-grams and sets are compared by 64-bit hashes.
    Other columns are not read.
    """
    return _named(documents, rule).drop("text_hash")


def _named(documents: DataFrame, rule: JaccardRule) -> DataFrame:
    """The rows of ``near_duplicates`` with the hash of their text."""
    frequent = frequencies(documents, rule)
    known = written(described(documents, frequent, rule), "shingles")
    held = _thinned(_cored(_shared_tokens(known.where("n_shingles > 0")), rule), rule)
    grouped = known.where("n_shingles > 0").join(held.select("class_id").distinct(), "class_id", "left_semi")
    classes = written(
        grouped.groupBy("class_id").agg(F.first("n_shingles").alias("n"), F.first("bitmap").alias("bitmap")), "classes"
    )

    pairs = written(_pivot_pairs(held, classes, rule), "pairs")
    links_ = _links(_pair_units(pairs, classes, rule), None, known, documents, frequent, rule)
    labels = components(links_, classes.select("class_id", F.col("class_id").alias("label")))
    open_ = _open_groups(held, labels)
    if not open_.isEmpty():
        units, large = _cluster_units(open_, classes, rule)
        links_ = links_.unionByName(_links(units, labels, known, documents, frequent, rule))
        if not large.isEmpty():
            pairs = written(_all_pairs(open_.join(large, "class_id", "left_semi"), classes, labels, rule), "pairs")
            links_ = links_.unionByName(_links(_pair_units(pairs, classes, rule), labels, known, documents, frequent, rule))
        labels = components(links_, labels)

    named = known.join(labels, "class_id", "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "class_id")).alias("label")
    )
    smallest = named.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "label", "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def distinct_documents(documents: DataFrame, rule: JaccardRule = JaccardRule()) -> DataFrame:
    """The documents (all columns) but one of each component: the one whose doc_id names it.

    Rows with a null id, and texts without words, all stay; so do repeated rows of an id that stays.
    Where one id has several texts, each of them stays or goes by its own component.
    """
    found = _named(documents, rule)
    copies = found.where("n_shingles > 0 AND doc_id <> component_id")
    gone = written(copies.select("doc_id", F.col("text_hash").alias("gone_text")).distinct(), "copies")
    words = key_filter(gone.select("doc_id"))
    stays = filtered_by(documents, words, "doc_id", there=False)
    asked = filtered_by(documents, words, "doc_id", there=True)
    same = (asked["doc_id"] == gone["doc_id"]) & (F.xxhash64(asked["text"]) == gone["gone_text"])
    return stays.unionByName(asked.join(gone, same, "left_anti").select(documents.columns))
