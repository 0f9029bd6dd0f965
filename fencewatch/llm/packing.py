"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

A sequence is filled greedily with the longest pieces that fit. Then its shortest piece is exchanged
for the two unpacked pieces that together fill the widened gap best, if they fill it better; the
exchanged piece goes back to the unpacked ones.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fencewatch.llm.common import as_batch, steps, texts

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
PACKED = PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))
#: Pieces that are packed together; bounds a task's memory whatever the size of its partition.
BLOCK = 1 << 18
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


#: How byte-level vocabularies of this family part a text before merging; fixed with the vocabulary.
_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, by its rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteLevelIds:
    """Token ids of texts as the tokenizers library gives them.

    The vocabulary file is read by that library. Texts without the string of a special token are
    merged by tiktoken from the ranks of the same vocabulary, which takes a third of the time; the
    others go to the library itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._special = [token.content for token in self._library.get_added_tokens_decoder().values()]
        letters = byte_alphabet()
        vocabulary = self._library.get_vocab(with_added_tokens=False)
        ranks = {bytes(letters[c] for c in token): n for token, n in vocabulary.items()}
        self._ranks = tiktoken.Encoding("ranks", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self._special):
            ids = self._library.encode(text, add_special_tokens=False).ids
        else:
            ids = self._ranks.encode_ordinary(text)
        return array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first of several may be shorter than the capacity."""
    first = length % capacity or capacity
    cuts = [0, *range(first, length + 1, capacity)]
    return list(zip(cuts[:-1], np.diff(cuts).tolist()))


def tokenized(documents: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """One row per piece of each document's ids followed by ``end_id``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteLevelIds(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in steps(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), map(encoder, texts(batch.column(1)))):
                ids += end
                for piece, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield as_batch(PIECES, list(zip(*rows)))

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def fill(lengths: list[int] | np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of lengths, by best-two-fit."""
    counts = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1).tolist()
    sequences = [[capacity]] * counts[capacity]
    counts[capacity] = 0
    there = sum(1 << n for n, count in enumerate(counts) if count)  # bit n: a piece of length n is left

    def take(n: int) -> None:
        nonlocal there
        counts[n] -= 1
        if not counts[n]:
            there ^= 1 << n

    def put_back(n: int) -> None:
        nonlocal there
        counts[n] += 1
        there |= 1 << n

    def longest(room: int) -> int:
        return (there & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 else -1

    def best_two(room: int, more_than: int) -> tuple[int, int] | None:
        best, found = more_than, None
        a = longest(room - 1)
        while a > 0 and 2 * a > best:
            b = longest(min(room - a, a))
            if b == a and counts[a] < 2:
                b = longest(a - 1)
            if b > 0 and a + b > best:
                best, found = a + b, (a, b)
                if best == room:
                    break
            a = longest(a - 1)
        return found

    while there:
        bin_, room = [], capacity
        while (n := longest(room)) > 0:
            take(n)
            bin_.append(n)
            room -= n
        if room:
            smallest = bin_[-1]
            if two := best_two(room + smallest, smallest):
                bin_[-1:] = two
                for n in two:
                    take(n)
                put_back(smallest)
        sequences.append(bin_)
    return sequences


def _placed(rows: pa.Table, capacity: int, first_id: int) -> tuple[pa.RecordBatch, int]:
    lengths = rows.column("length").to_numpy()
    sequences = fill(lengths, capacity)
    order = np.argsort(lengths, kind="stable")
    next_of = np.searchsorted(lengths[order], np.arange(capacity + 2)).tolist()
    at, sequence, offset = [], [], []
    for number, bin_ in enumerate(sequences, first_id):
        place = 0
        for n in bin_:
            at.append(next_of[n])
            next_of[n] += 1
            sequence.append(number)
            offset.append(place)
            place += n
    taken = rows.take(pa.array(order[np.array(at, np.int64)])).combine_chunks()
    columns = [column.chunk(0) for column in taken.columns]
    return as_batch(PACKED, [*columns, sequence, offset]), first_id + len(sequences)


def packed(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give every piece a sequence and a place in it; no sequence is longer than ``capacity``.

    Each shuffle partition is packed by itself, in blocks of a bounded number of pieces: whole corpora
    need no common state, and only the last few sequences of a block can be less than full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= BLOCK:
                out, number = _placed(pa.Table.from_batches(held), capacity, number)
                held, count = [], 0
                yield out
        if held:
            yield _placed(pa.Table.from_batches(held), capacity, number)[0]

    spread = pieces.repartition(F.xxhash64("doc_id", "piece")).sortWithinPartitions("doc_id", "piece")
    return spread.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(documents: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Tokenize and pack.

    Null text is an empty document (its end id alone); repeated rows are packed as often as they
    occur; a null doc_id stays null; no row in, no row out. Columns other than doc_id and text are
    not used.
    """
    return packed(tokenized(documents, vocabulary, end_id, capacity), capacity)
