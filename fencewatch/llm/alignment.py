"""Alignment of two tokenizers over a corpus: which tokens of one overlap which tokens of the other, and how often.

The first pass encodes every text with both tokenizers, keeps the ids, and gathers the different pairs of linked
ids. A minimal perfect hash gives each pair a number of its own: keys are dealt to parts, and each
part places its keys by rounds of hashing, a bit for each key that had its place to itself. Counts are dense
vectors indexed by that number: sums of parts of the corpus, then the sum of these sums. The pairs stand
in a vector of the same order, so that every look-up is verified. The second pass aligns the documents again
and looks the counts of their links up. Where the pairs are too many to be sent to all tasks, the links meet
the counts in a join instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fencewatch.llm.common import STEP_BYTES, mix, steps, texts
from fencewatch.llm.packing import ByteLevelIds, byte_alphabet
from fencewatch.sources.scratch import fresh_path

_LONGS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@dataclass(frozen=True)
class AlignRule:
    """The hash has ``parts`` parts; count vectors are summed over ``sums`` parts of the corpus before all are. A task keeps
    up to ``held`` pairs before it passes them on. Up to ``sent`` pairs (twelve bytes each) are sent to all tasks.
    """

    parts: int = 256
    sums: int = 4
    held: int = 1 << 21
    sent: int = 1 << 24


class TokenPair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self._a = ByteLevelIds(byte_level)
        self._b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_alphabet()
        vocabulary = self._a._library.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, n in vocabulary.items():
            a_bytes[n] = bytes(letters[c] for c in token if c in letters)
        self.a_sizes = np.array([len(b) for b in a_bytes], np.int64)
        self._b_bytes = [self._piece(n) for n in range(self._b.get_piece_size())]
        self.b_sizes = np.array([len(b) for b in self._b_bytes], np.int64)

    def _piece(self, n: int) -> bytes:
        piece = self._b.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(n) else piece.replace("▁", " ").encode()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none where their bytes are not those of a space and the text."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        wanted = (" " + text).encode()
        b = self._b.encode(text)
        if b"".join(map(self._b_bytes.__getitem__, b)) != wanted:
            return none, none
        a = np.array(self._a._ranks.encode_ordinary(" " + text), np.int64)
        if self.a_sizes[a].sum() != len(wanted):
            return none, none
        return a, np.array(b, np.int64)


@dataclass(frozen=True)
class Sizes:
    """Bytes of each token of both vocabularies; the same for every corpus."""

    a: np.ndarray
    b: np.ndarray


class Alignment:
    """The links of some documents: token occurrences of both sides whose bytes overlap.

    Between two neighbouring ends, of whichever side, lies one token of each: those two are a link.
    """

    def __init__(self, a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray, sizes: Sizes):
        self.a, self.b, self.a_bounds, self.b_bounds = a, b, a_bounds, b_bounds
        a_ends, b_ends = np.cumsum(sizes.a[a]), np.cumsum(sizes.b[b])
        total = int(a_ends[-1]) if len(a) else 0
        docs = np.append(0, a_ends)[a_bounds]
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[a_ends], is_b[b_ends] = True, True
        ends = np.flatnonzero(is_a | is_b)
        at_a, at_b = is_a[ends], is_b[ends]
        self.link_a = np.cumsum(at_a) - at_a
        self.link_b = np.cumsum(at_b) - at_b
        self.link_bounds = np.searchsorted(ends, docs, side="right")
        both = at_a & at_b
        self.n_groups = np.diff(np.append(0, np.cumsum(both))[self.link_bounds])
        # The group of each token: groups that end before its own end.
        group = np.cumsum(both) - both
        self.a_group, self.b_group = group[at_a], group[at_b]

    def pairs(self, width: int) -> np.ndarray:
        return self.a[self.link_a] * width + self.b[self.link_b]

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.link_bounds) - 1), np.diff(self.link_bounds))


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``size``, one place left for what follows, and how many there are."""
    names = [b"%d" % n for n in range(size)]
    width = len(names[-1]) + 1
    return np.frombuffer(b"".join(n.ljust(width) for n in names), np.uint8).reshape(size, width), np.array([len(n) for n in names])


class GroupTexts:
    """Writes the groups of aligned documents as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, sizes: Sizes):
        self._digits, self._lengths = _digits(max(len(sizes.a), len(sizes.b)))

    def __call__(self, found: Alignment) -> pa.Array:
        n_a, n_b = len(found.a), len(found.b)
        if not n_a:
            return pa.array([""] * (len(found.a_bounds) - 1), pa.string())
        # A stable sort by (group, side) brings the tokens of a group together, both sides in order.
        order = np.argsort(np.concatenate([found.a_group * 2, found.b_group * 2 + 1]), kind="stable")
        ids = np.concatenate([found.a, found.b])[order]
        key = np.concatenate([found.a_group * 2, found.b_group * 2 + 1])[order]
        after = np.append(key[1:], -1)
        sign = np.where(after == key, ord(","), np.where(key & 1 == 0, ord("|"), ord(";"))).astype(np.uint8)
        flat = self._digits[ids]
        lengths = self._lengths[ids]
        flat[np.arange(len(ids)), lengths] = sign
        keep = np.arange(flat.shape[1])[None, :] <= lengths[:, None]
        ends = np.append(0, np.cumsum(lengths + 1))
        bounds = ends[found.a_bounds + found.b_bounds]
        # The sign after a document's last token is left out.
        last = np.searchsorted(ends, bounds[1:][np.diff(bounds) > 0]) - 1
        keep[last, lengths[last]] = False
        full = np.append(0, np.cumsum(np.diff(bounds) > 0))
        out = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer((bounds - full).astype(np.int64)), pa.py_buffer(flat[keep]))
        return out.cast(pa.string())


def _ids_bounds(column: pa.Array) -> np.ndarray:
    """Where the 16-bit numbers of each binary cell begin."""
    column = column.cast(pa.large_binary())
    return np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) // 2


def _ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 16-bit numbers of binary cells, and where each row's begin."""
    bounds, data = _ids_bounds(column), column.cast(pa.large_binary()).buffers()[2]
    size = int(bounds[-1] - bounds[0])
    flat = np.frombuffer(data, "<u2", size, 2 * int(bounds[0])) if size else np.zeros(0, np.uint16)
    return flat.astype(np.int64), bounds - bounds[0]


def _aligned(batches: Iterator[pa.RecordBatch], a: int, b: int, sizes: Sizes) -> Iterator[tuple[pa.RecordBatch, Alignment]]:
    """Pieces of the batches, of a bounded number of bytes or one row each, with their alignments."""
    for batch in batches:
        low, starts = 0, _ids_bounds(batch.column(a))
        while low < batch.num_rows:
            high = int(np.searchsorted(starts, starts[low] + STEP_BYTES // 4, side="right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            piece = batch.slice(low, high - low)
            a_ids, a_bounds = _ids_of(piece.column(a))
            b_ids, b_bounds = _ids_of(piece.column(b))
            yield piece, Alignment(a_ids, a_bounds, b_ids, b_bounds, sizes)
            low = high


class PairHash:
    """A minimal perfect hash of different whole numbers: each gets its own number below their count."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], rest: np.ndarray, n: int):
        self._levels, self._rest, self.n = levels, rest, n

    @staticmethod
    def _places(keys: np.ndarray, level: int, bits: int | np.ndarray) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (mix(keys.astype(np.uint64) + salt) % np.asarray(bits, np.uint64)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PairHash:
        levels, left, ranked = [], keys, 0
        while len(left) and len(levels) < 40:
            bits = -(-2 * len(left) // 64) * 64
            place = cls._places(left, len(levels), bits)
            alone = np.bincount(place, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            before = ranked + np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])
            levels.append((words, before))
            ranked += int(alone.sum())
            left = left[~alone[place]]
        return cls(levels, np.sort(left), len(keys))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.n - len(self._rest), np.int64)
        open_ = np.arange(len(keys))
        for level, (words, before) in enumerate(self._levels):
            place = self._places(keys[open_], level, 64 * len(words))
            word, bit = words[place >> 6], (place & 63).astype(np.uint64)
            hit = word >> bit & np.uint64(1) != 0
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = before[(place >> 6)[hit]] + below[hit]
            open_ = open_[~hit]
            if not len(open_):
                return out
        out[open_] += np.searchsorted(self._rest, keys[open_])
        return np.minimum(out, self.n - 1)

    def packed(self) -> tuple[list[bytes], bytes]:
        return [words.tobytes() for words, _ in self._levels], self._rest.astype("<i8").tobytes()

    @classmethod
    def unpacked(cls, levels: list[bytes], rest: bytes, n: int) -> PairHash:
        made, ranked = [], 0
        for data in levels:
            words = np.frombuffer(data, "<u8")
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            made.append((words, ranked + np.append(0, ones[:-1])))
            ranked += int(ones[-1])
        return cls(made, np.frombuffer(rest, "<i8"), n)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) % parts


def _kept(frame: DataFrame, name: str) -> DataFrame:
    """A written table, packed more tightly than by default."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def token_ids(documents: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(row, doc_id, a, b) of every document: the ids of both tokenizers as 16-bit numbers, and a number for the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenPair(byte_level, pieces)
        for batch in steps(batches):
            found = [tokens(text) for text in texts(batch.column(1))]
            sides = [pa.array([ids[side].astype("<u2").tobytes() for ids in found], pa.binary()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *sides], ["doc_id", "a", "b"])

    rows = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, a binary, b binary")
    return _kept(rows.withColumn("row", F.monotonically_increasing_id()), "token-ids")


def _pair_runs(ids: DataFrame, sizes: Sizes, rule: AlignRule) -> DataFrame:
    """(part, pair, n): in how many documents of a task a pair of ids is linked."""
    width, space = len(sizes.b), len(sizes.a) * len(sizes.b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs, n = (np.concatenate(c) for c in zip(*held))
            known, at = np.unique(pairs, return_inverse=True)
            return known, np.bincount(at, n, len(known)).astype(np.int64)

        def out(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for low in range(0, len(pairs), 1 << 17):
                some = pairs[low : low + (1 << 17)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_part(some, rule.parts), pa.int32()), pa.array(some), pa.array(n[low : low + (1 << 17)])], ["part", "pair", "n"]
                )

        for _, found in _aligned(batches, 0, 1, sizes):
            in_docs = np.unique(found.owners() * space + found.pairs(width)) % space
            held.append(np.unique(in_docs, return_counts=True))
            size += len(held[-1][0])
            if size >= rule.held:
                known, n = merged()
                held, size = [(known, n)], len(known)
                if 2 * size >= rule.held:
                    yield from out(known, n)
                    held, size = [], 0
        if held:
            yield from out(*merged())

    return _kept(ids.select("a", "b").mapInArrow(run, "part int, pair long, n long"), "pair-runs")


def _hashed(runs: DataFrame, rule: AlignRule) -> DataFrame:
    """(part, n, levels, rest, pairs): the hash of each part's pairs, and the pairs in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def made() -> pa.RecordBatch:
            keys = np.concatenate(held)
            numbers = PairHash.of(keys)
            ordered = np.empty(len(keys), np.int64)
            ordered[numbers(keys)] = keys
            levels, rest = numbers.packed()
            columns = [[last], [len(keys)], [levels], [rest], [ordered.tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), ["part", "n", "levels", "rest", "pairs"])

        for batch in batches:
            part, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if held and part[low] != last:
                    yield made()
                    held = []
                if high > low:
                    last = int(part[low])
                    held.append(pair[low:high])
        if held:
            yield made()

    different = runs.select("part", "pair").distinct()
    dealt = different.repartition("part").sortWithinPartitions("part", "pair")
    return _kept(dealt.mapInArrow(run, "part int, n long, levels array<binary>, rest binary, pairs binary"), "pair-hash")


def _summed(vectors: DataFrame, *keys: str) -> DataFrame:
    """Vectors (*keys, counts) added up where the keys are equal."""
    names = [*keys, "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for *key, data in zip(*[batch.column(i).to_pylist() for i in range(len(names))]):
                vector = np.frombuffer(zlib.decompress(data), np.int64)
                if key != last:
                    if last is not None:
                        yield row(last, total)
                    last, total = key, np.zeros(len(vector), np.int64)
                total += vector
        if last is not None:
            yield row(last, total)

    def row(key: list, total: np.ndarray) -> pa.RecordBatch:
        data = zlib.compress(total.tobytes(), 1)
        return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], pa.array([data], pa.binary())], names)

    schema = ", ".join(f"{k} int" for k in keys) + ", counts binary"
    return vectors.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _vectors(runs: DataFrame, hashes: DataFrame, rule: AlignRule) -> DataFrame:
    """(part, counts): for each part the dense vector of its pairs' counts, summed as a tree.

    A leaf of the tree adds the runs of one part from one of ``sums`` parts of the corpus.
    """

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, numbers, vector = None, None, None

        def made() -> pa.RecordBatch:
            data = zlib.compress(vector.tobytes(), 1)
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int32()), pa.array([data], pa.binary())], ["part", "counts"])

        for batch in batches:
            part, leaf, pair, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            first = np.flatnonzero(batch.column(5).is_valid().to_numpy(zero_copy_only=False))
            cuts = sorted({0, *first.tolist(), *(first + 1).tolist(), batch.num_rows})
            starts = set(first.tolist())
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low in starts:  # a part's hash comes before its runs
                    if last is not None:
                        yield made()
                    last = (int(part[low]), int(leaf[low]))
                    numbers = PairHash.unpacked(batch.column(4)[low].as_py(), batch.column(5)[low].as_py(), int(n[low]))
                    vector = np.zeros(int(n[low]), np.int64)
                else:
                    np.add.at(vector, numbers(pair[low:high]), n[low:high])
        if last is not None:
            yield made()

    none = {"levels": F.lit(None).cast("array<binary>"), "rest": F.lit(None).cast("binary")}
    rows = runs.select("part", F.pmod(F.spark_partition_id(), F.lit(rule.sums)).alias("leaf"), "pair", "n").withColumns(none)
    every = F.explode(F.sequence(F.lit(0), F.lit(rule.sums - 1))).alias("leaf")
    heads = hashes.select("part", every, F.lit(None).cast("long").alias("pair"), "n", "levels", "rest")
    dealt = rows.unionByName(heads).repartition("part", "leaf").sortWithinPartitions("part", "leaf", F.col("rest").isNull())
    return _summed(dealt.mapInArrow(leaves, "part int, counts binary"))


def _summed(vectors: DataFrame) -> DataFrame:
    """Vectors (part, counts) added up by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vector = np.frombuffer(zlib.decompress(data), np.int64)
                if part != last:
                    if last is not None:
                        yield made()
                    last, total = part, np.zeros(len(vector), np.int64)
                total += vector
        if last is not None:
            yield made()

    return vectors.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, counts binary")


class PairCounts:
    """The counts of all pairs behind one hash, put together from its parts."""

    def __init__(self, rows: list, parts: int, width: int, n_a: int):
        rows = sorted(rows, key=lambda r: r["part"])
        self._parts = parts
        sizes = np.zeros(parts, np.int64)
        sizes[[r["part"] for r in rows]] = [r["n"] for r in rows]
        base = np.cumsum(sizes) - sizes
        depth = max((len(r["levels"]) for r in rows), default=0)
        self._levels = []
        ranked = base.copy()
        for level in range(depth):
            start, bits = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
            words, before, at = [], [], 0
            for r in rows:
                if level < len(r["levels"]):
                    p, some = r["part"], np.frombuffer(r["levels"][level], "<u8")
                    ones = np.cumsum(np.bitwise_count(some), dtype=np.int64)
                    start[p], bits[p] = at, 64 * len(some)
                    words.append(some)
                    before.append(ranked[p] + np.append(0, ones[:-1]))
                    ranked[p] += ones[-1]
                    at += len(some)
            self._levels.append((start, bits, np.concatenate(words), np.concatenate(before)))
        rest = [(np.frombuffer(r["rest"], "<i8"), base[r["part"]] + r["n"]) for r in rows]
        keys = np.concatenate([k for k, _ in rest]) if rest else np.zeros(0, np.int64)
        numbers = np.concatenate([end - len(k) + np.arange(len(k)) for k, end in rest]) if rest else keys
        order = np.argsort(keys)
        self._rest, self._rest_numbers = keys[order], numbers[order]
        self.pairs = np.concatenate([np.frombuffer(r["pairs"], "<i8") for r in rows]) if rows else np.zeros(0, np.int64)
        self.counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        self.best = np.zeros(n_a, np.int64)
        np.maximum.at(self.best, self.pairs // width, self.counts)
        if len(self.pairs) and self.pairs.max() < 2**32 and self.counts.max() < 2**31:
            self.pairs, self.counts = self.pairs.astype(np.uint32), self.counts.astype(np.int32)

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        """The counts of pairs; a pair that was not counted is an error."""
        part = _part(pairs, self._parts)
        number = np.full(len(pairs), -1, np.int64)
        open_ = np.arange(len(pairs))
        for level, (start, bits, words, before) in enumerate(self._levels):
            here = part[open_]
            open_ = open_[bits[here] > 0]
            here = part[open_]
            place = PairHash._places(pairs[open_], level, bits[here])
            at, bit = start[here] + (place >> 6), (place & 63).astype(np.uint64)
            hit = words[at] >> bit & np.uint64(1) != 0
            below = np.bitwise_count(words[at] & ((np.uint64(1) << bit) - np.uint64(1)))
            number[open_[hit]] = before[at[hit]] + below[hit]
            open_ = open_[~hit]
        left = np.flatnonzero(number < 0)
        if len(left) and len(self._rest):
            at = np.minimum(np.searchsorted(self._rest, pairs[left]), len(self._rest) - 1)
            number[left] = self._rest_numbers[at]
        if len(pairs) and ((number < 0) | (self.pairs[number] != pairs)).any():
            raise ValueError("a pair of linked tokens was not counted")
        return self.counts[number].astype(np.int64)


def pair_counts(ids: DataFrame, sizes: Sizes, rule: AlignRule = AlignRule()) -> DataFrame:
    """(part, n, levels, rest, pairs, counts): the hash of all linked pairs and, in its order, the pairs and their counts."""
    runs = _pair_runs(ids, sizes, rule)
    hashes = _hashed(runs, rule)
    return _kept(hashes.join(_vectors(runs, hashes, rule), "part"), "pair-counts")


def _basic(found: Alignment) -> list[np.ndarray]:
    return [np.diff(found.a_bounds), np.diff(found.b_bounds), found.n_groups, np.diff(found.link_bounds)]


def _looked_up(ids: DataFrame, sizes: Sizes, counts: PairCounts) -> DataFrame:
    shared = ids.sparkSession.sparkContext.broadcast((counts, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes_ = shared.value
        write, width = GroupTexts(sizes_), len(sizes_.b)
        for piece, found in _aligned(batches, 1, 2, sizes_):
            pairs, at = np.unique(found.pairs(width), return_inverse=True)
            n = known(pairs)
            best = n == known.best[pairs // width]
            owner, docs = found.owners(), piece.num_rows
            n_best = np.bincount(owner[best[at]], minlength=docs)
            total = np.append(0, np.cumsum(n[at]))[found.link_bounds]
            longs = [*_basic(found), n_best, np.diff(total)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *[pa.array(c, pa.int64()) for c in longs], write(found)], ["doc_id", *_LONGS, "groups"]
            )

    schema = "doc_id long, " + ", ".join(f"{name} long" for name in _LONGS) + ", groups string"
    return ids.select("doc_id", "a", "b").mapInArrow(run, schema)


def _joined(ids: DataFrame, sizes: Sizes, table: DataFrame) -> DataFrame:
    """The rows of ``_looked_up`` by joins: links meet counts on their pair, then documents on their row."""
    width = len(sizes.b)
    space = len(sizes.a) * width
    shared = ids.sparkSession.sparkContext.broadcast(sizes)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = np.frombuffer(pairs, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs), pa.array(pairs // width), pa.array(np.frombuffer(counts, np.int64))], ["pair", "a_id", "count"]
                )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, found in _aligned(batches, 1, 2, shared.value):
            key, n = np.unique(found.owners() * space + found.pairs(width), return_counts=True)
            rows = piece.column(0).take(pa.array(key // space))
            yield pa.RecordBatch.from_arrays([rows, pa.array(key % space), pa.array(n)], ["row", "pair", "n"])

    def basic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = GroupTexts(shared.value)
        for piece, found in _aligned(batches, 2, 3, shared.value):
            longs = [pa.array(c, pa.int64()) for c in _basic(found)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *longs, write(found)], ["row", "doc_id", *_LONGS[:4], "groups"])

    counted = table.select("pairs", "counts").mapInArrow(unpack, "pair long, a_id long, count long")
    best = counted.groupBy("a_id").agg(F.max("count").alias("best"))  # as many rows as the vocabulary has entries
    counted = counted.join(best, "a_id").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    links = ids.select("row", "a", "b").mapInArrow(link, "row long, pair long, n long").join(counted, "pair")
    sums = links.groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")
    )
    longs = ", ".join(f"{name} long" for name in _LONGS[:4])
    rows = ids.select("row", "doc_id", "a", "b").mapInArrow(basic, f"row long, doc_id long, {longs}, groups string")
    zero = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").select(
        "doc_id", *_LONGS[:4], F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups"
    )


def aligned(documents: DataFrame, byte_level: str, pieces: str, rule: AlignRule = AlignRule()) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of documents (doc_id, text).

    A is the byte-level tokenizer, given a space and the text, B the piece tokenizer. ``groups`` are the tokens
    between byte places where both sides have an end, as ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and texts that the
    tokens do not spell byte by byte, have no tokens: zeros and empty groups. Repeated rows each count as a document;
    a null doc_id stays null; no row in, no row out. A very long text is held whole by one task, with its ids and some
    100 bytes a token. Other columns are not read.
    """
    tokens = TokenPair(byte_level, pieces)
    sizes = Sizes(tokens.a_sizes, tokens.b_sizes)
    if max(len(sizes.a), len(sizes.b)) > 1 << 16:
        raise ValueError("ids are kept as 16-bit numbers")
    ids = token_ids(documents, byte_level, pieces)
    table = pair_counts(ids, sizes, rule)
    if (table.agg(F.sum("n")).first()[0] or 0) > rule.sent:
        return _joined(ids, sizes, table)
    return _looked_up(ids, sizes, PairCounts(table.collect(), rule.parts, len(sizes.b), len(sizes.a)))
