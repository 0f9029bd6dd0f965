"""A trie of ordered sets, and which of its sets are alike to a given one."""

from __future__ import annotations

import numpy as np


class SetTrie:
    """Sets of 64-bit numbers, each in the one order of the whole corpus: frequent numbers first, equals by number.

    Edges are runs of numbers that the sets below share. A search goes down level by level; a node's
    overlap is its parent's and that of its own edge, so that sets share all of the work for a common
    beginning. A subtree is left as soon as no length in it can still reach the wanted likeness, or
    when all its sets are in the searching set's own class.
    """

    def __init__(self, sets: list[np.ndarray], percent: int = 80, frequency=None):
        self.percent = percent
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        self._numbers, place = np.unique(np.concatenate(sets), return_inverse=True)
        rank = np.arange(len(self._numbers))
        if frequency is not None:
            rank[np.argsort(-frequency(self._numbers), kind="stable")] = np.arange(len(rank))
        self._rank = rank
        ranks = rank[place]
        flat = ranks[np.lexsort((ranks, owner))].astype(">u4")
        ends = np.cumsum(sizes)
        rows = [flat[e - n : e] for e, n in zip(ends, sizes)]
        self.order = sorted(range(len(sets)), key=lambda i: rows[i].tobytes())
        rows = [rows[i] for i in self.order]
        self.sizes = sizes[self.order]
        self._build(rows)

    def _build(self, rows: list[np.ndarray]) -> None:
        # (depth, first row, nodes below) of the nodes that are still open; a row's leaf ends at its size.
        made: list[list] = []  # [start depth, end depth, first row, end row, children]
        open_ = [[0, 0, []]]
        for i, row in enumerate(rows):
            leaf = [None, len(row), i, i + 1, []]
            made.append(leaf)
            open_[-1][2].append(leaf)
            shared = 0
            if i + 1 < len(rows):
                after = rows[i + 1]
                n = min(len(row), len(after))
                differ = np.flatnonzero(row[:n] != after[:n])
                shared = int(differ[0]) if len(differ) else n
            low = i
            while open_[-1][0] > shared:
                depth, low, below = open_.pop()
                node = [None, depth, low, i + 1, below]
                made.append(node)
                if open_[-1][0] < shared:
                    open_.append([shared, low, [node]])
                else:
                    open_[-1][2].append(node)
            if open_[-1][0] < shared:
                last = open_[-1][2].pop()
                open_.append([shared, last[2], [last]])
        root = [0, 0, 0, len(rows), open_[0][2]]
        level, nodes = [root], []
        while level:
            nodes += level
            for node in level:
                for child in node[4]:
                    child[0] = node[1]
            level = [child for node in level for child in node[4]]
        self._start = np.array([n[0] for n in nodes], np.int64)
        self._end = np.array([n[1] for n in nodes], np.int64)
        self._low = np.array([n[2] for n in nodes], np.int64)
        self._high = np.array([n[3] for n in nodes], np.int64)
        self._children = np.array([len(n[4]) for n in nodes], np.int64)
        self._first_child = 1 + np.cumsum(self._children) - self._children
        self._longest = np.array([self.sizes[n[2] : n[3]].max() for n in nodes], np.int64)
        self._shortest = np.array([self.sizes[n[2] : n[3]].min() for n in nodes], np.int64)
        lengths = self._end - self._start
        self._edge_at = np.cumsum(lengths) - lengths
        self._edges = np.concatenate([rows[n[2]][n[0] : n[1]] for n in nodes]).astype(np.int64)

    def one_class(self, labels: np.ndarray) -> np.ndarray:
        """For each node whether all rows below it have one label; ``labels`` in row order."""
        change = np.append(0, np.cumsum(labels[1:] != labels[:-1]))
        return change[self._high - 1] == change[self._low]

    def search(self, wanted: np.ndarray, label: int, labels: np.ndarray, one: np.ndarray) -> list[int]:
        """Rows (in row order) of other classes that are alike to ``wanted``, a sorted set of distinct numbers."""
        n, percent = len(wanted), self.percent
        there = np.minimum(np.searchsorted(self._numbers, wanted), len(self._numbers) - 1)
        held = np.zeros(len(self._numbers), np.int64)
        held[self._rank[there[self._numbers[there] == wanted]]] = 1
        nodes, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(nodes):
            longest, depth = self._longest[nodes], self._end[nodes]
            # 100 * inner >= percent * union, with union = n + size - inner; the best case is the longest row.
            able = (100 + percent) * (overlap + longest - depth) >= percent * (n + longest)
            able &= (100 + percent) * n >= percent * (n + self._shortest[nodes])
            able &= ~(one[nodes] & (labels[self._low[nodes]] == label))
            nodes, overlap = nodes[able], overlap[able]
            leaf = self._children[nodes] == 0
            if leaf.any():
                rows, inner = self._low[nodes[leaf]], overlap[leaf]
                good = (100 + percent) * inner >= percent * (n + self.sizes[rows])
                found += rows[good].tolist()
                nodes, overlap = nodes[~leaf], overlap[~leaf]
            counts = self._children[nodes]
            if not len(counts):
                break
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            overlap = np.repeat(overlap, counts)
            nodes = np.repeat(self._first_child[nodes], counts) + inside
            lengths = self._end[nodes] - self._start[nodes]
            at = np.arange(lengths.sum()) + np.repeat(self._edge_at[nodes] - (np.cumsum(lengths) - lengths), lengths)
            sums = np.append(0, np.cumsum(held[self._edges[at]]))
            ends = np.cumsum(lengths)
            overlap = overlap + sums[ends] - sums[ends - lengths]
        return found


def links(
    rows: list[tuple[int, int, np.ndarray]], probes: list[tuple[int, int, np.ndarray]], percent: int = 80, frequency=None
) -> list[tuple[int, int]]:
    """Links (id, id) that join all classes which the probes can join with rows of the trie.

    Rows and probes are (id, label, sorted distinct numbers); equal labels are known to be joined. ``frequency``
    gives the corpus-wide part of the order for an array of numbers. Links inside a class, known or found
    on the way, are left out, so that a group of near copies costs one search and not all its pairs.
    """
    if not rows or not probes:
        return []
    trie = SetTrie([numbers for _, _, numbers in rows], percent, frequency)
    known = {label: i for i, label in enumerate(dict.fromkeys(l for part in (rows, probes) for _, l, _ in part))}
    root = np.arange(len(known))
    ids = [rows[i][0] for i in trie.order]
    start = np.array([known[rows[i][1]] for i in trie.order], np.int64)
    labels, one, out = start, trie.one_class(start), []
    for number, label, numbers in probes:
        mine = int(root[known[label]])
        hits = trie.search(numbers, mine, labels, one)
        new = {}
        for row in hits:
            if labels[row] != mine:
                new.setdefault(int(labels[row]), row)
        if new:
            out += [(number, ids[row]) for row in new.values()]
            root[np.isin(root, [*new])] = mine
            labels = root[start]
            one = trie.one_class(labels)
    return out
