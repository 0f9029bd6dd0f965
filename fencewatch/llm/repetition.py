"""Quality rules on repetition inside a text, by suffix arrays over its words.

All texts of a step share one suffix array: the words of different texts never count as equal, so
every common prefix stays inside a text. Ranks by doubling (only words whose rank is still shared are
ranked again) give the order, and the same ranks give the longest common prefix of neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fencewatch.llm.common import appended, flat_text, is_space, mix, span_hashes, text_of, word_bounds

#: Words of the windows that the base rule counts.
WINDOW = 8
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
FIELDS = [
    ("n_words", "long"),
    ("word_chars", "long"),
    ("n_symbols", "long"),
    ("n_dup_lines", "long"),
    ("n_repeat_words", "long"),
    ("base_failed", "boolean"),
    ("kept", "boolean"),
    ("repeat_share", "double"),
    ("longest_repeat", "long"),
]


@dataclass(frozen=True)
class RepetitionRule:
    """Limits: repeats of fewer words than ``least`` do not count."""

    least: int = 8
    most_share: float = 0.3
    most_words: int = 50
    min_words: int = 20
    base_percent: int = 30


def _ranks(keys: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Rank of the 1, 2, 4, ... words from each place, until no rank is shared; ``ends``: of the place's text."""
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    first = np.cumsum(counts) - counts
    rank = first[which].astype(np.int32)
    levels, step = [rank], 1
    active = np.flatnonzero(counts[which] > 1)
    while len(active):
        after = active + step
        inside = after < ends[active]
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[after[inside]] + 1
        key = rank[active].astype(np.int64) << 32 | second
        order = np.argsort(key, kind="stable")
        place, key = active[order], key[order]
        index = np.arange(len(place))
        new_group = np.append(True, key[1:] >> 32 != key[:-1] >> 32)
        new_part = np.append(True, key[1:] != key[:-1])
        group_at = np.maximum.accumulate(np.where(new_group, index, 0))
        part_at = np.maximum.accumulate(np.where(new_part, index, 0))
        rank = rank.copy()
        rank[place] += (part_at - group_at).astype(np.int32)
        levels.append(rank)
        parts = np.cumsum(new_part) - 1
        active = np.sort(place[np.bincount(parts)[parts] > 1])
        step *= 2
    return levels


def longest_repeats(keys: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """For each place the length of the longest repeat that starts there, 0 below ``least`` words.

    The deepest interval of common prefixes that a suffix lies in has the larger of the prefixes it
    shares with its two neighbours in the suffix array as its value. A repeat that could be extended
    to the left lies in the span of the one from the place before, so that the spans of all places
    together are the spans of the maximal repeats.
    """
    longest = np.zeros(len(keys), np.int64)
    levels = _ranks(keys, ends)
    depth = max(least.bit_length() - 1, 0)  # 2 ** depth <= least
    if len(levels) <= depth:
        return longest
    order = np.empty(len(keys), np.int64)
    order[levels[-1]] = np.arange(len(keys))
    shared = np.flatnonzero(levels[depth][order[1:]] == levels[depth][order[:-1]])
    left, right = order[shared], order[shared + 1]
    common = np.zeros(len(left), np.int64)
    for level in reversed(range(len(levels))):
        a, b = left + common, right + common
        inside = np.flatnonzero((a < ends[left]) & (b < ends[right]))
        same = levels[level][a[inside]] == levels[level][b[inside]]
        common[inside[same]] += 1 << level
    common[common < least] = 0
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def _covered(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Which places lie in a span."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(flags, dtype=np.int64))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def measure(column: pa.Array, rule: RepetitionRule = RepetitionRule()) -> list[np.ndarray]:
    """The arrays of FIELDS for a column of texts."""
    data, offsets = flat_text(column)
    n = len(offsets) - 1
    starts, ends, words_at = word_bounds(data, offsets)
    n_words = np.diff(words_at)
    owner = np.repeat(np.arange(n), n_words)
    letters = _per_text(((data & 0xC0) != 0x80) & ~is_space(data), offsets)
    symbols = _per_text(_SYMBOL[data], offsets)

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_ends = np.sort(np.concatenate([offsets[1:], breaks]))
    full = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_owner = np.searchsorted(offsets, line_starts, side="right") - 1
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    line_keys = span_hashes(data, line_starts, line_ends) ^ salt[line_owner]
    _, once = np.unique(line_keys, return_index=True)
    dup_lines = np.bincount(line_owner, minlength=n) - np.bincount(line_owner[once], minlength=n)

    keys = mix(span_hashes(data, starts, ends) ^ salt[owner])
    longest = longest_repeats(keys, words_at[owner + 1], min(rule.least, WINDOW))
    windows = np.flatnonzero(longest >= WINDOW)
    repeated = _per_text(_covered(windows, np.full(len(windows), WINDOW), len(keys)), words_at)
    spans = np.flatnonzero(longest >= rule.least)
    covered = _per_text(_covered(spans, longest[spans], len(keys)), words_at)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[spans], longest[spans])

    share = covered / np.maximum(n_words, 1)
    failed = (n_words < rule.min_words) | (100 * repeated > rule.base_percent * n_words)
    kept = ~failed & (share <= rule.most_share) & (most <= rule.most_words)
    return [n_words, letters, symbols, dup_lines, repeated, failed, kept, share, most]


def measured(frame: DataFrame, rule: RepetitionRule = RepetitionRule(), text: str = "text") -> DataFrame:
    """The frame with the columns of FIELDS; columns of these names are replaced.

    Null text counts as empty: no words, so it fails the base rule. Repeated rows stay and are
    judged alike; no row in, no row out. No other column is read.
    """
    return appended(frame, FIELDS, lambda: lambda batch: measure(text_of(batch, text), rule), text)


def kept(frame: DataFrame, rule: RepetitionRule = RepetitionRule(), text: str = "text") -> DataFrame:
    """The rows whose text passes, with the frame's own columns."""
    return appended(frame, FIELDS, lambda: lambda batch: measure(text_of(batch, text), rule), text, keep=lambda made: made[6])
