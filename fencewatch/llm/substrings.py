"""Removal of passages that repeat across documents, by relative Lempel-Ziv parsing.

Documents are factored against blocks of reference text. A document need not meet every block: each
window of 50 words names one of its own 25-word runs (the one of least hash) as its anchor, so equal
windows have equal anchors, and the passages around an anchor that several documents hold all go to the
block that indexes this anchor. A block is a suffix array over its passages with the number of each
passage's document; a passage is cut greedily into the longest factors that occur in documents of smaller
number. A factor of 50 words or more is a duplicate span. A window can also begin inside one factor and end
in the next, so that starts before a factor boundary are looked up as far as both factors reach.

Passages that are equal word by word meet no block: one of them stands for all. An anchor with
very many different passages (a line that a third of all texts hold) is lengthened to whole windows,
which then are equal or have nothing in common; their counts are combined before they are moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fencewatch.llm.common import _powers_to, filtered_by, flat_text, key_filter, mix, perhaps_there, span_hashes, steps, word_bounds
from fencewatch.operators.keyed import aggregate_per_key
from fencewatch.sources.scratch import written

_SPAN = "struct<start:int,mask:bigint>"


@dataclass(frozen=True)
class SpanRule:
    """A window has ``words`` words and its anchor ``anchor``. Anchors of more than ``passages`` different passages
    are lengthened; a reference block is closed once it holds ``block`` words."""

    words: int = 50
    anchor: int = 25
    passages: int = 1000
    block: int = 250_000

    def __post_init__(self):
        if not 0 < self.words - self.anchor < 62:
            raise ValueError("a window has to be longer than its anchor, by 61 words at most")


def _run_hashes(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of words."""
    up, down = _powers_to(len(keys) + 1)
    sums = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(keys * up[: len(keys)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each place the first place of the least value among the ``width`` values from there."""
    at = np.arange(len(values))
    held = 1
    while held < width:
        step = min(held, width - held)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        held += step
    return at


def passages_of(data: np.ndarray, offsets: np.ndarray, rule: SpanRule) -> tuple[np.ndarray, ...]:
    """(text, anchor, passage, start, windows) of the runs of windows that share an anchor place."""
    starts, ends, first = word_bounds(data, offsets)
    keys = span_hashes(data, starts, ends)
    many = np.maximum(np.diff(first) - rule.words + 1, 0)
    none = np.zeros(0, np.int64)
    if not many.sum():
        return none, none, none, none, none
    owner = np.repeat(np.arange(len(many)), many)
    window = np.arange(len(owner)) + np.repeat(first[:-1] - (np.cumsum(many) - many), many)
    grams = _run_hashes(keys, np.arange(len(keys) - rule.anchor + 1), np.arange(rule.anchor, len(keys) + 1))
    place = _least_places(grams, rule.words - rule.anchor + 1)[window]
    cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(cut[1:], len(place)) - 1
    low, high = window[cut], window[last] + rule.words
    passage = _run_hashes(keys, low, high)
    who = owner[cut]
    return who, grams[place[cut]].view(np.int64), passage.view(np.int64), low - first[who], last - cut + 1


def _known(documents: DataFrame, rule: SpanRule) -> DataFrame:
    """(doc_id, text_hash, anchor, passage, start, windows) of all documents with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            who, anchor, passage, start, windows = passages_of(*flat_text(batch.column(1)), rule)
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), batch.column(2).take(at), pa.array(anchor), pa.array(passage),
                    pa.array(start, pa.int32()), pa.array(windows, pa.int32()),
                ],
                ["doc_id", "text_hash", "anchor", "passage", "start", "windows"],
            )

    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, anchor long, passage long, start int, windows int")


def _read_again(documents: DataFrame, wanted: DataFrame, rule: SpanRule) -> DataFrame:
    """(key, passage, doc_id, offset, words) of wanted passages (doc_id, text_hash, passage, anchor, start, windows, hot).

    Words are 64-bit hashes. A hot passage gives a row for each of its windows, with the window's hash as
    key, its number as offset and no words; any other one row with its anchor as key and offset -1.
    """
    lists = wanted.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("anchor", "passage", "start", "windows", "hot")).alias("wanted")
    )
    lists = written(lists, "wanted")
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = filtered_by(texts, key_filter(lists.select("text_hash")), "text_hash", there=True)
    joined = texts.dropDuplicates(["doc_id", "text_hash"]).join(lists, ["doc_id", "text_hash"]).select("doc_id", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, offsets = flat_text(batch.column(1))
            starts, ends, first = word_bounds(data, offsets)
            keys = span_hashes(data, starts, ends)
            lists_ = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), lists_.value_lengths().to_numpy())
            anchor, passage, start, windows, hot = (c.to_numpy(zero_copy_only=False) for c in lists_.flatten().flatten())
            low = first[owner] + start
            doc = batch.column(0).to_numpy()[owner]
            for some in (~hot, hot):
                if not some.any():
                    continue
                n, at = windows[some].astype(np.int64), low[some]
                if hot[some][0]:
                    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    from_ = np.repeat(at, n) + inside
                    key = _run_hashes(keys, from_, from_ + rule.words).view(np.int64)
                    words = pa.nulls(len(key), pa.list_(pa.int64()))
                    columns = [key, np.repeat(passage[some], n), np.repeat(doc[some], n), inside]
                else:
                    n += rule.words - 1
                    place = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(keys[place].view(np.int64)))
                    columns = [anchor[some], passage[some], doc[some], np.full(len(n), -1)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns[:3]), pa.array(columns[3], pa.int32()), words],
                    ["key", "passage", "doc_id", "offset", "words"],
                )

    return joined.mapInArrow(run, "key long, passage long, doc_id long, offset int, words array<long>")


class ReferenceBlock:
    """Passages indexed by a suffix array, in which matches are looked for in documents of smaller number."""

    #: Words by which suffixes are ordered and matches are measured, as a power of two.
    LEVELS = 7

    def __init__(self, keys: np.ndarray, bounds: np.ndarray, docs: np.ndarray):
        sizes = np.diff(bounds)
        self.ends = np.repeat(bounds[1:], sizes)
        self._ranks = [np.unique(keys, return_inverse=True)[1]]
        place, n = np.arange(len(keys)), len(keys) + 1
        for level in range(self.LEVELS - 1):
            after = place + (1 << level)
            inside = after < self.ends
            second = np.zeros(len(keys), np.int64)
            second[inside] = self._ranks[-1][after[inside]] + 1
            self._ranks.append(np.unique(self._ranks[-1] * n + second, return_inverse=True)[1])
        self._order = np.argsort(self._ranks[-1], kind="stable")
        self._rank = np.empty(len(keys), np.int64)
        self._rank[self._order] = place
        self._docs = np.unique(docs, return_inverse=True)[1].astype(np.int32)[np.repeat(np.arange(len(sizes)), sizes)][self._order]
        self._least = [self._docs]
        while 2 << len(self._least) - 1 <= len(keys):
            half = 1 << len(self._least) - 1
            self._least.append(np.minimum(self._least[-1][:-half], self._least[-1][half:]))

    def _neighbours(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest suffixes before and after in order, of documents of smaller number; -1 and the size for none."""
        mine, size = self._docs[rank], len(self._docs)
        low, high = rank.copy(), rank + 1
        for level in reversed(range(len(self._least))):
            step, least = 1 << level, self._least[level]
            at = np.maximum(low - step, 0)
            low = np.where((low >= step) & (least[np.minimum(at, len(least) - 1)] >= mine), at, low)
            fits = high + step <= size
            high = np.where(fits & (least[np.minimum(high, len(least) - 1)] >= mine), high + step, high)
        return low - 1, high

    def _common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        common = np.zeros(len(left), np.int64)
        most = np.minimum(self.ends[left] - left, self.ends[right] - right)
        for level in reversed(range(self.LEVELS)):
            inside = np.flatnonzero(common < most)
            a, b = left[inside] + common[inside], right[inside] + common[inside]
            same = self._ranks[level][a] == self._ranks[level][b]
            common[inside[same]] += 1 << level
        return np.minimum(common, most)

    def longest(self, at: np.ndarray) -> np.ndarray:
        """Words from each place that also occur in a document of smaller number."""
        out = np.zeros(len(at), np.int64)
        low, high = self._neighbours(self._rank[at])
        for near, there in ((low, low >= 0), (high, high < len(self._order))):
            some = np.flatnonzero(there)
            out[some] = np.maximum(out[some], self._common(at[some], self._order[near[some]]))
        return out


def repeated_windows(block: ReferenceBlock, bounds: np.ndarray, words: int) -> np.ndarray:
    """Where in the block's passages a window starts that a document of smaller number holds too.

    All passages are parsed side by side, a factor of each in a step.
    """
    found = np.zeros(int(bounds[-1]), bool)
    at, stop = bounds[:-1].copy(), bounds[1:]
    before = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        here = at[open_]
        length = block.longest(here)
        long = np.flatnonzero(length >= words)
        n = length[long] - words + 1
        found[np.repeat(here[long] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = True
        # Starts inside the factor before whose window ends inside this one.
        first = np.maximum(here - before[open_] + 1, here - words + 1)
        n = np.maximum(np.minimum(here - 1, here + length - words) - first + 1, 0)
        across = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if len(across):
            found[across[block.longest(across) >= words]] = True
        before[open_] = np.maximum(length, 1)
        at[open_] = here + before[open_]
        open_ = open_[at[open_] < stop[open_]]
    return found


def _parsed(texts: DataFrame, rule: SpanRule) -> DataFrame:
    """(passage, mask): a bit for each window of a passage that repeats one of a smaller document."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        passage, doc, words, sizes = (np.concatenate(c) for c in zip(*held))
        bounds = np.append(0, np.cumsum(sizes))
        found = repeated_windows(ReferenceBlock(words.view(np.uint64), bounds, doc), bounds, rule.words)
        place = np.flatnonzero(found)
        who = np.searchsorted(bounds, place, side="right") - 1
        mask = np.zeros(len(passage), np.int64)
        np.bitwise_or.at(mask, who, np.int64(1) << (place - bounds[who]))
        hit = mask != 0
        return pa.RecordBatch.from_arrays([pa.array(passage[hit]), pa.array(mask[hit])], ["passage", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, passage, doc = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(4)
            sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            bounds = np.append(0, np.cumsum(sizes))
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if held and key[low] != last and size >= rule.block:
                    yield solve(held)
                    held, size = [], 0
                held.append((passage[low:high], doc[low:high], flat[bounds[low] : bounds[high]], sizes[low:high]))
                size, last = size + int(bounds[high] - bounds[low]), key[low]
        if held:
            yield solve(held)

    rows = texts.where("offset < 0").repartition("key").sortWithinPartitions("key", "doc_id", "passage")
    return rows.mapInArrow(run, "passage long, mask long")


def duplicate_spans(documents: DataFrame, rule: SpanRule = SpanRule()) -> DataFrame:
    """(doc_id, text_hash, spans) of documents (doc_id, text) that hold a window of a document of smaller id.

    ``spans`` lists (start, mask): the windows that start at word ``start + i`` for each set bit ``i``.
    ``text_hash`` is xxhash64 of the text. Rows without id or text are in no row. Repeated rows are one.
    """
    known = written(_known(documents, rule), "anchors")
    spread = aggregate_per_key(known, ["anchor"], F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    held = written(known.join(spread.where("low < high").select("anchor"), "anchor", "left_semi"), "shared-anchors")
    first = F.min(F.struct("doc_id", "text_hash", "start", "windows")).alias("first")
    passages = written(held.groupBy("anchor", "passage").agg(first).select("anchor", "passage", "first.*"), "passages")

    groups = aggregate_per_key(passages, ["anchor"], F.count("*").alias("n")).where("n > 1")
    wanted = passages.join(groups, "anchor").withColumn("hot", F.col("n") > rule.passages)
    texts = written(_read_again(documents, wanted, rule), "passage-words")
    windows = texts.where("offset >= 0").select("key", "passage", "doc_id", "offset")
    lows = aggregate_per_key(windows, ["key"], F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    bit = F.expr("bit_or(shiftleft(1L, offset))").alias("mask")
    lengthened = windows.join(lows.select("key", "low"), "key").where("doc_id > low").groupBy("passage").agg(bit)
    masks = _parsed(texts, rule).unionByName(lengthened)

    judged = passages.select("passage", F.col("doc_id").alias("low"), "windows").join(masks, "passage", "left")
    judged = written(judged.select("passage", "low", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")), "passage-masks")
    all_ = F.expr("shiftleft(1L, windows) - 1")
    rows = held.join(judged, "passage").select(
        "doc_id", "text_hash", "start", F.when(F.col("doc_id") > F.col("low"), all_).otherwise(F.col("mask")).alias("mask")
    )
    once = rows.where("mask <> 0").groupBy("doc_id", "text_hash")
    return once.agg(F.collect_set(F.struct("start", "mask")).alias("spans"))


def _kept_words(texts: pa.Array, spans: pa.Array | None, words: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of words, of removed ones, and the other words of each text joined by one space."""
    data, offsets = flat_text(texts)
    starts, ends, first = word_bounds(data, offsets)
    n_words = np.diff(first)
    change = np.zeros(len(starts) + 1, np.int64)
    if spans is not None:
        spans = spans.fill_null([]) if spans.null_count else spans
        owner = np.repeat(np.arange(len(n_words)), spans.value_lengths().to_numpy())
        start, mask = (c.to_numpy(zero_copy_only=False) for c in spans.flatten().flatten())
        for bit in range(62):
            some = np.flatnonzero(mask >> bit & 1)
            at = first[owner[some]] + start[some] + bit
            np.add.at(change, at, 1)
            np.add.at(change, at + words, -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    owner = np.searchsorted(first, kept, side="right") - 1
    n_kept = np.bincount(owner, minlength=len(n_words))
    # A kept word that is not its text's last is followed by a blank, which becomes the one space.
    between = ends[kept[:-1]][owner[1:] == owner[:-1]]
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, starts[kept], 1)
    np.add.at(edge, ends[kept], -1)
    take = np.cumsum(edge[:-1]) > 0
    data = data.copy()
    data[between] = 0x20
    take[between] = True
    sizes = np.append(0, np.cumsum(take, dtype=np.int64))[offsets]
    joined = pa.LargeStringArray.from_buffers(len(n_words), pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data[take]))
    return n_words, n_words - n_kept, joined.cast(pa.string())


def without_repeats(documents: DataFrame, rule: SpanRule = SpanRule()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: the words that no repeated window covers, joined by one space.

    A window repeats if its word sequence also starts in a document of smaller doc_id; all windows are
    judged on the input. A null, empty or blank text has no words and keeps an empty text. A row without
    id is nobody's copy and keeps all its words, as do texts shorter than a window. Rows of one id are never
    copies of each other; repeated rows stay and lose the same words. Very long texts are held
    whole by one task, with some 30 bytes a word besides. No row in, no row out; other columns are not read.
    """
    spans = written(duplicate_spans(documents, rule), "duplicate-spans")
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    keys = key_filter(spans.select("text_hash"))
    shared = documents.sparkSession.sparkContext.broadcast(keys)
    words = rule.words
    schema = "doc_id long, n_words long, n_removed long, kept string"

    def run(batches: Iterator[pa.RecordBatch], some: bool) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            if not some:
                batch = batch.filter(pa.array(~perhaps_there(shared.value, batch.column(2).to_numpy())))
            made = _kept_words(batch.column(1), batch.column(2) if some else None, words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(made[0]), pa.array(made[1]), made[2]],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    untouched = rows.mapInArrow(lambda batches: run(batches, False), schema)
    asked = filtered_by(rows, keys, "text_hash", there=True)
    found = spans.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "spans")
    joined = asked.join(found, (F.col("doc_id") == F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    return untouched.unionByName(joined.select("doc_id", "text", "spans").mapInArrow(lambda batches: run(batches, True), schema))
