"""Ranked lexical search: the best documents for each query text, by range maxima over posting lists.

Queries are a stated set that is held against all documents, in blocks of a bounded size. Two passes read
the texts: one counts what the weights need, the other builds an index of the query terms for a shard of
documents at a time and searches it. Every posting list has a sparse table of range maxima of its impacts, so
the best that a range of documents can reach is bounded by a sum of one look-up per term. The search
takes the range with the highest bound, splits it at the document of the largest impact in it, scores that document,
and goes on until no range can reach the last of the best documents any more. Tasks keep their best documents from
shard to shard; only these leave a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fencewatch.llm.common import flat_text, span_hashes, steps

_TERM = np.zeros(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM[_first : _last + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class RankRule:
    """``most`` documents per query. ``saturation`` and ``length`` (percent) shape the impact of a term's occurrences.
    A block of queries has about ``block`` bytes of text, a shard about ``postings`` postings; ``together`` ranges are
    split in one step of the search.
    """

    most: int = 20
    saturation: int = 12
    length: int = 25
    block: int = 4_000_000
    postings: int = 1_000_000
    together: int = 16


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms, and where each text's begin; A-Z count as a-z."""
    data, offsets = flat_text(column)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = _TERM[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return span_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


@dataclass(frozen=True)
class QueryBlock:
    """Queries with their terms as numbers into the sorted ``hashes``."""

    ids: list
    hashes: np.ndarray
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple]) -> QueryBlock:
        """From rows (item_id, text); queries without terms find nothing and are left out."""
        hashes, bounds = term_hashes(pa.array([text for _, text in rows], pa.string()))
        known, number = np.unique(hashes, return_inverse=True)
        ids, terms, repeats = [], [], []
        for (item_id, _), low, high in zip(rows, bounds[:-1], bounds[1:]):
            if low < high:
                which, n = np.unique(number[low:high], return_counts=True)
                ids.append(item_id)
                terms.append(which)
                repeats.append(n.astype(np.int64))
        return QueryBlock(ids, known, terms, repeats)

    def postings(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms with repeats of each text, and (text, term, occurrences) of the query terms in them."""
        hashes, bounds = term_hashes(column)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        hit = np.flatnonzero(self.hashes[at] == hashes) if len(self.hashes) else np.zeros(0, np.int64)
        owner = np.searchsorted(bounds, hit, side="right") - 1
        size = max(len(self.hashes), 1)
        key, n = np.unique(owner * size + at[hit], return_counts=True)
        return np.diff(bounds), key // size, key % size, n


@dataclass(frozen=True)
class Corpus:
    """What the weights are made of: documents with a term, all terms, and documents with each query term."""

    documents: int
    terms: int
    holding: np.ndarray

    def weights(self) -> np.ndarray:
        return np.floor(1000 * np.log((2 * self.documents + 2) / (2 * self.holding + 1))).astype(np.int64)

    def impacts(self, weights: np.ndarray, n: np.ndarray, occurrences: np.ndarray, rule: RankRule) -> np.ndarray:
        m = 100 - rule.length + (rule.length * n * self.documents) // max(self.terms, 1)
        return weights * ((1_000_000_000 * occurrences) // (1000 * occurrences + rule.saturation * m))


def counted(documents: DataFrame, queries: QueryBlock) -> Corpus:
    """One pass over all texts; the driver gets one row per query term and two more."""
    shared = documents.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        holding, totals = np.zeros(len(block.hashes), np.int64), np.zeros(2, np.int64)
        for batch in steps(batches):
            n, _, term, _ = block.postings(batch.column(0))
            holding += np.bincount(term, minlength=len(holding))
            totals += [np.count_nonzero(n), n.sum()]
        term = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append([-2, -1], term)), pa.array(np.append(totals, holding[term]))], ["term", "n"]
        )

    rows = documents.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {row["term"]: row["n"] for row in rows}
    holding = np.array([found.get(i, 0) for i in range(len(queries.hashes))], np.int64)
    return Corpus(found.get(-2, 0), found.get(-1, 0), holding)


class Shard:
    """Posting lists of some documents, which are numbered in the order of their ids."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, term))
        self._n_docs = n_docs
        self._doc, self._impact = doc[order], impact[order]
        self._keys = term[order] * n_docs + self._doc
        self._bounds = np.searchsorted(self._keys, np.arange(n_terms + 1) * n_docs)
        self._log = np.zeros(max(int(np.diff(self._bounds).max(initial=0)) + 1, 2), np.int64)
        for i in range(2, len(self._log)):
            self._log[i] = self._log[i >> 1] + 1
        # Place of the largest impact among 2 ** level postings from each one, the first of equal ones.
        best = [np.arange(len(order), dtype=np.int32)]
        for level in range(int(self._log[-1])):
            left = best[-1]
            right = np.append(left[1 << level :], np.full(min(1 << level, len(left)), len(left) - 1, np.int32))
            best.append(np.where(self._impact[left] >= self._impact[right], left, right).astype(np.int32))
        self._best = np.stack(best)

    def _highest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest impact of each range of postings and its place; 0 for an empty range."""
        level = self._log[high - low]
        last = len(self._impact) - 1
        left = self._best[level, np.minimum(low, last)]
        right = self._best[level, np.clip(high - (1 << level), 0, last)]
        a, b = self._impact[left], self._impact[right]
        full = high > low
        return np.where(full, np.maximum(a, b), 0), np.where(a >= b, left, right)

    def search(self, terms: np.ndarray, repeats: np.ndarray, best: list[tuple], ids: list, rule: RankRule) -> list[tuple]:
        """The best (-score, no id, id) of those given and this shard's documents, best first.

        ``ids`` holds (no id, id) of the shard's documents in their order.
        """
        there = self._bounds[terms] < self._bounds[terms + 1]
        terms, repeats = terms[there], repeats[there]
        best = best[:]
        if not len(terms):
            return best
        base = terms * self._n_docs

        def worth(bound: int, first: int) -> bool:
            """Whether a range of this bound, from this document on, can still hold one of the best."""
            return bound > 0 and (len(best) < rule.most or (-bound, *ids[first]) < best[-1])

        heap: list[tuple] = []
        number = 0

        def put(bounds: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            nonlocal number
            for k in np.flatnonzero(bounds > 0):
                if worth(bound := int(bounds[k]), int(first[k])):
                    number += 1
                    heapq.heappush(heap, (-bound, int(first[k]), number, low[k], high[k]))

        low, high = self._bounds[terms][None, :], self._bounds[terms + 1][None, :]
        put((self._highest(low, high)[0] * repeats).sum(1), np.zeros(1, np.int64), low, high)
        while heap and worth(-heap[0][0], heap[0][1]):
            taken = [heapq.heappop(heap) for _ in range(min(rule.together, len(heap)))]
            first = np.array([t[1] for t in taken])
            low, high = np.stack([t[3] for t in taken]), np.stack([t[4] for t in taken])
            value, place = self._highest(low, high)
            split = place[np.arange(len(taken)), (value * repeats).argmax(1)]
            doc = self._doc[split]
            at = np.minimum(np.maximum(np.searchsorted(self._keys, base[None, :] + doc[:, None]), low), high)
            last = len(self._keys) - 1
            holds = (at < high) & (self._keys[np.minimum(at, last)] == base[None, :] + doc[:, None])
            scores = (np.where(holds, self._impact[np.minimum(at, last)], 0) * repeats).sum(1)
            for score, d in zip(scores.tolist(), doc.tolist()):
                if score > 0 and (len(best) < rule.most or (-score, *ids[d]) < best[-1]):
                    best.append((-score, *ids[d]))
                    best.sort()
                    del best[rule.most :]
            after = at + holds
            put((self._highest(low, at)[0] * repeats).sum(1), first, low, at)
            put((self._highest(after, high)[0] * repeats).sum(1), doc + 1, after, high)
        return best


def _best_of_tasks(documents: DataFrame, queries: QueryBlock, corpus: Corpus, rule: RankRule) -> DataFrame:
    """(query, doc_id, score) of the best documents of every task."""
    shared = documents.sparkSession.sparkContext.broadcast((queries, corpus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts = shared.value
        weights = counts.weights()
        best: list[list[tuple]] = [[] for _ in block.ids]
        held: list[tuple] = []
        n_docs = size = 0

        def search() -> None:
            ids = [i for part in held for i in part[0]]
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            doc, term, impact = (np.concatenate(c) for c in list(zip(*held))[1:])
            shard = Shard(term, rank[doc], impact, len(ids), len(block.hashes))
            ordered = [(ids[i] is None, ids[i] or 0) for i in order]
            for q, (terms, repeats) in enumerate(zip(block.terms, block.repeats)):
                best[q] = shard.search(terms, repeats, best[q], ordered, rule)

        for batch in steps(batches):
            n, doc, term, occurrences = block.postings(batch.column(1))
            if len(doc):
                impact = counts.impacts(weights[term], n[doc], occurrences, rule)
                used, doc = np.unique(doc, return_inverse=True)
                held.append((batch.column(0).take(pa.array(used)).to_pylist(), n_docs + doc, term, impact))
                n_docs, size = n_docs + len(used), size + len(doc)
            if size >= rule.postings:
                search()
                held, n_docs, size = [], 0, 0
        if held:
            search()
        rows = [(q, None if none else i, -score) for q, found in enumerate(best) for score, none, i in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["query", "doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "query long, doc_id long, score long")


def best_documents(documents: DataFrame, items: DataFrame, rule: RankRule = RankRule()) -> DataFrame:
    """(item_id, rank, doc_id, score) of the best documents (doc_id, text) for each item (item_id, text).

    Equal scores go by ascending doc_id, a null id last; ranks are from 1. Null and empty texts have no terms: such a
    document is in no result, such an item has none. Repeated documents each count and may each be ranked;
    repeated rows of an item are one item, different texts under one id are ranked each by itself. No item or no
    document, no row. Terms are compared by 64-bit hashes. A very long text is held by one task. Other columns are not read.
    """
    asked = items.where("text IS NOT NULL").select("item_id", "text").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // rule.block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    results = None
    for number in range(blocks):
        rows = asked.where(F.col("block") == number).select("item_id", "text").collect()
        queries = QueryBlock.of(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        found = _best_of_tasks(documents, queries, counted(documents, queries), rule)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rule.most)
        names = documents.sparkSession.createDataFrame(
            [(n, i) for n, i in enumerate(queries.ids)], "query long, item_id long"
        )
        named = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        results = named if results is None else results.unionByName(named)
    return results
