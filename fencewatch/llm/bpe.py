"""Byte-pair encoding and decoding with a word-wise vocabulary, by batched merge rounds in numpy.

The words of a batch that are not known yet are laid out in one flat array of symbols. A round looks up
every neighbouring pair by binary search over the sorted pair keys, picks each word's pair of lowest
rank, and merges all its occurrences; words without a pair to merge are done. A text is then the
sequence of its words' ids.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fencewatch.llm.common import steps, texts

#: Unicode white space; the vocabulary's rules part words there. Fixed values.
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = regex.compile(f"[^{_BLANK}]+")
#: How this family of vocabularies parts words of ASCII text after lower-casing; fixed with the vocabulary.
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_BLANK}\p{{L}}\p{{N}}]+")
#: The same for texts of Latin-1 alone, with the blank between them as a word. What is a letter, a digit or a capital there
#: is the same in all versions of Unicode, and no two of these characters compose.
_LATIN_WORD = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+| "
)
_LATIN = re.compile(r"[\x00-\xff]+").fullmatch
#: Blanks of ``str.split`` that are none of the vocabulary's; the others are the same.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_NONE = np.int32(2**31 - 1)
#: Words whose ids a task keeps; beyond, the store starts afresh with those of the batch, which costs time only.
KEPT_WORDS = 300_000


def chunks_of(text: str) -> list[str]:
    """What stands between the blanks of a text."""
    return _CHUNK.findall(text) if any(mark in text for mark in _SEPARATORS) else text.split()


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary, by its rule."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encodes and decodes with a vocabulary file whose words end in a suffix."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        self._library = Tokenizer.from_file(path)
        model = stored["model"]
        ids = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self._special = {token["content"]: token["id"] for token in stored["added_tokens"]}
        self._at_special = regex.compile("|".join(map(regex.escape, self._special)) or r"(?!)")
        self._letter_special = any(re.search("^[A-Za-z]+$", token) for token in self._special)
        letters = byte_letters()
        self._byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self._inner = np.array([ids[c] for c in letters], np.int64)
        self._final = np.array([ids[c + end] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks, self._made = keys[order], order.astype(np.int32), made[order]
        names = {n: token for token, n in ids.items()} | {n: s for s, n in self._special.items()}
        self._names = [names.get(n, "") for n in range(max(names) + 1)]
        self._known: dict[str, bytes] = {}
        self._plain: dict[str, str] = {}
        self._chunks: dict[str, bytes] = {}

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of the pair that starts at each place; no rank where none can be merged."""
        rank, made = np.full(len(at), _NONE, np.int32), np.zeros(len(at), np.int64)
        there = np.flatnonzero(at + 1 < len(symbols))
        there = there[owner[at[there]] == owner[at[there] + 1]]
        key = symbols[at[there]] << 32 | symbols[at[there] + 1]
        place = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        hit = self._keys[place] == key
        rank[there[hit]], made[there[hit]] = self._ranks[place[hit]], self._made[place[hit]]
        return rank, made

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers."""
        encoded = [word.encode() for word in words]
        sizes = np.array([len(word) for word in encoded], np.int64)
        data = np.frombuffer(b"".join(encoded), np.uint8)
        symbols = self._inner[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self._final[data[last]]
        owner = np.repeat(np.arange(len(words)), sizes)
        rank, made = self._pairs(symbols, owner, np.arange(len(symbols)))
        done_symbols, done_owners = [], []
        while len(symbols):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            spread = np.repeat(lowest, np.diff(np.append(first, len(owner))))
            ended = spread == _NONE
            done_symbols.append(symbols[ended])
            done_owners.append(owner[ended])
            # Of pairs that overlap, as in a run of one symbol, every second is merged from the left.
            at = np.flatnonzero((rank == spread) & ~ended)
            if not len(at):
                break
            run = np.append(True, np.diff(at) != 1)
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            symbols[at] = made[at]
            keep = ~ended
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            # Only pairs with a merged symbol are new.
            near = np.concatenate((at, np.maximum(at - 1, 0)))
            rank[near], made[near] = self._pairs(symbols, owner, near)
        symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        owner = np.concatenate(done_owners) if done_owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        flat = symbols[order].astype("<i4").tobytes()
        cuts = (np.searchsorted(owner[order], np.arange(len(words) + 1)) * 4).tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _words(self, chunk: str) -> list[str | int]:
        """Words of a text without blanks; a special token is its id."""
        words: list[str | int] = []
        at = 0
        for found in self._at_special.finditer(chunk):
            words += self._plain_words(chunk[at : found.start()])
            words.append(self._special[found[0]])
            at = found.end()
        return words + self._plain_words(chunk[at:])

    def _plain_words(self, text: str) -> list[str]:
        """Words of a text without blanks and special tokens."""
        return _WORD.findall(text.lower()) if text.isascii() else self._library_words([text])[0]

    def _latin_words(self, texts_: list[str]) -> list[list[str]]:
        """Words of Latin-1 texts without blanks and special tokens, in one search for all."""
        words: list[list[str]] = [[]]
        for word in _LATIN_WORD.findall(" ".join(texts_).lower()):
            if word == " ":
                words.append([])
            else:
                words[-1].append(word)
        return words if texts_ else []

    def _library_words(self, texts_: list[str]) -> list[list[str]]:
        """Words of texts without blanks, in one call of the library for all.

        Letters, their lower case and their composition are those of the library's version of Unicode, so texts beyond
        Latin-1 are normalized and parted by the library; merging is done here. A blank composes with nothing, so it
        keeps the texts apart.
        """
        normal = self._library.normalizer.normalize_str(" ".join(texts_))
        parts = self._library.pre_tokenizer.pre_tokenize_str(normal)
        starts = np.append(0, np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 0x20) + 1)
        if len(starts) != len(texts_):
            raise ValueError("the vocabulary's rules add or drop blanks")
        owner = np.searchsorted(starts, [start for _, (start, _) in parts], side="right") - 1
        words: list[list[str]] = [[] for _ in texts_]
        plain, byte_of = self._plain, self._byte_of
        for (part, _), text in zip(parts, owner.tolist()):
            word = plain.get(part)
            if word is None:
                word = plain[part] = bytes([byte_of[letter] for letter in part]).decode()
            words[text].append(word)
        return words

    def _learn(self, chunks: set[str]) -> None:
        if len(self._chunks) > KEPT_WORDS:
            self._chunks = {chunk: self._chunks[chunk] for chunk in chunks if chunk in self._chunks}
        if len(self._known) > KEPT_WORDS:
            self._known.clear()
            self._plain.clear()
        chunks_, known = self._chunks, self._known
        new = [chunk for chunk in chunks if chunk not in chunks_]
        letters = {chunk: chunk.lower() for chunk in new if chunk.isalpha() and (chunk.isascii() or _LATIN(chunk))}
        if self._letter_special:
            letters = {}
        rest = [chunk for chunk in new if chunk not in letters]
        split: dict[str, list[str | int]] = {}
        # One search tells whether any of them holds a special token at all: none has a blank.
        if self._at_special.search(" ".join(rest)):
            split = {chunk: self._words(chunk) for chunk in rest if self._at_special.search(chunk)}
            rest = [chunk for chunk in rest if chunk not in split]
        latin = [chunk for chunk in rest if chunk.isascii() or _LATIN(chunk)]
        split.update(zip(latin, self._latin_words(latin)))
        beyond = [chunk for chunk in rest if chunk not in split]
        if beyond:
            split.update(zip(beyond, self._library_words(beyond)))
        words = {word for words in split.values() for word in words if isinstance(word, str)}
        fresh = [word for word in words.union(letters.values()) if word not in known]
        if fresh:
            known.update(zip(fresh, self._merged(fresh)))
        chunks_.update([(chunk, known[word]) for chunk, word in letters.items()])
        for chunk, found in split.items():
            chunks_[chunk] = b"".join(
                [known[w] if isinstance(w, str) else np.array([w], "<i4").tobytes() for w in found]
            )

    def encode(self, rows: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        parts = [chunks_of(text) for text in rows]
        self._learn(set().union(*parts))
        chunks = self._chunks
        return [b"".join(map(chunks.__getitem__, row)) for row in parts]

    def decode(self, ids: np.ndarray) -> str:
        """Names of the ids joined by one blank: these vocabularies name no decoder of their own."""
        names = self._names
        return " ".join([names[n] for n in ids.tolist()])


def encoded(frame: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ``ids`` (array of int) and ``decoded`` (the ids turned back into text) of every row.

    Null or empty text has no ids and decodes to an empty text; repeated rows and null keys stay as
    they are; other columns are not used.
    """
    kind = frame.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(vocabulary)
        for batch in steps(batches, text):
            found = bpe.encode(texts(batch.column(1)))
            ends = np.cumsum([0, *(len(ids) // 4 for ids in found)])
            flat = np.frombuffer(b"".join(found), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            back = [bpe.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(back, pa.string())], [key, "ids", "decoded"])

    return frame.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")
