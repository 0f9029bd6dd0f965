"""A quality score by a small convolutional network over the bytes of whole texts, in numpy.

Every four bytes are embedded, together with the share of them that lies in a word equal to one of the
four words before. Learned filters look at each eight bytes, moving on by four. Their rectified
outputs are averaged over chunks of 256 bytes, each overlapping the next by half, and chunks cover
the whole text. A text is described by the largest chunk value of each filter and the mean of all
its chunks; a small dense layer turns these into one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.llm.common import appended, flat_text, span_hashes, text_of, word_bounds

_STEP = 4
_BLOCK = 32  # steps of half a chunk
_BYTES = _STEP * _BLOCK
_LAGS = (1, 2, 3, 4)


@dataclass(frozen=True)
class Training:
    """``most_rows`` labelled rows at most, of texts up to ``most_bytes``, bound what the driver gathers."""

    most_rows: int = 2500
    most_bytes: int = 20_000
    width: int = 4
    filters: int = 16
    hidden: int = 12
    epochs: int = 10
    least_steps: int = 500
    batch: int = 50
    rate: float = 0.01
    seed: int = 7


@dataclass
class Inputs:
    """Texts laid out in blocks of 128 bytes; every text has one block at least."""

    bytes_: np.ndarray  # (steps, 4)
    repeated: np.ndarray  # (steps, 1)
    valid: np.ndarray  # (steps, 1): the filter that starts here lies in its text
    first: np.ndarray  # first block of each text
    after: np.ndarray  # the block after each block, or itself at a text's end


def laid_out(column: pa.Array) -> Inputs:
    data, offsets = flat_text(column)
    sizes = np.diff(offsets)
    blocks = np.maximum(1, -(-sizes // _BYTES))
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    target = np.arange(len(data)) + np.repeat(first * _BYTES - offsets[:-1], sizes)
    flat = np.zeros(total * _BYTES, np.uint8)
    flat[target] = data
    starts, ends, _ = word_bounds(data, offsets)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    keys = span_hashes(data, starts, ends)
    again = np.zeros(len(keys), bool)
    for lag in _LAGS:
        again[lag:] |= (keys[lag:] == keys[:-lag]) & (owner[lag:] == owner[:-lag])
    change = np.zeros(len(data) + 1, np.int8)
    change[starts[again]] += 1
    change[ends[again]] -= 1
    marks = np.zeros(total * _BYTES, np.float32)
    marks[target] = np.cumsum(change[:-1], dtype=np.int8)
    at = np.arange(total * _BLOCK) * _STEP - np.repeat(first * _BYTES, blocks * _BLOCK)
    length = np.repeat(sizes, blocks * _BLOCK)
    valid = ((at + _STEP < length) | (at == 0)).astype(np.float32)
    after = np.arange(1, total + 1)
    after[first + blocks - 1] -= 1
    return Inputs(flat.reshape(-1, _STEP), marks.reshape(-1, _STEP).mean(1, keepdims=True), valid[:, None], first, after)


class ByteNetwork:
    def __init__(self, settings: Training):
        draw = np.random.default_rng(settings.seed)
        d, f, h = settings.width, settings.filters, settings.hidden
        shapes = {"embed": (256, d), "left": (_STEP * d + 1, f), "right": (_STEP * d + 1, f), "bias": (f,)}
        shapes |= {"dense": (2 * f, h), "dense_bias": (h,), "out": (h, 1), "out_bias": (1,)}
        self.settings = settings
        self.weights = {
            name: (draw.normal(size=shape) / np.sqrt(max(1, shape[0] if name != "embed" else 2))).astype(np.float32)
            if "bias" not in name
            else np.zeros(shape, np.float32)
            for name, shape in shapes.items()
        }

    def forward(self, x: Inputs) -> tuple[np.ndarray, dict]:
        w = self.weights
        rows = np.concatenate([w["embed"][x.bytes_].reshape(len(x.bytes_), -1), x.repeated], axis=1)
        act = rows @ w["left"] + w["bias"]
        act[:-1] += (rows @ w["right"])[1:]
        np.maximum(act, 0, out=act)
        act *= x.valid
        sums = act.reshape(-1, _BLOCK, act.shape[1]).sum(1)
        counts = x.valid.reshape(-1, _BLOCK).sum(1)
        double = (x.after != np.arange(len(x.after)))[:, None]
        chunk_counts = np.maximum(1, counts + np.where(double[:, 0], counts[x.after], 0))
        chunks = (sums + np.where(double, sums[x.after], 0)) / chunk_counts[:, None]
        largest = np.maximum.reduceat(chunks, x.first)
        sizes = np.diff(np.append(x.first, len(chunks)))
        mean = np.add.reduceat(chunks, x.first) / sizes[:, None]
        pooled = np.concatenate([largest, mean], axis=1)
        hidden = np.maximum(pooled @ w["dense"] + w["dense_bias"], 0)
        logit = (hidden @ w["out"] + w["out_bias"])[:, 0]
        kept = dict(rows=rows, act=act, chunks=chunks, counts=chunk_counts, double=double, largest=largest)
        return logit, kept | dict(sizes=sizes, pooled=pooled, hidden=hidden)

    def score(self, column: pa.Array) -> np.ndarray:
        logit = self.forward(laid_out(column))[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def gradients(self, x: Inputs, labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        logit, k = self.forward(x)
        error = ((1 / (1 + np.exp(-logit)) - labels) / len(labels)).astype(np.float32)[:, None]
        g = {"out": k["hidden"].T @ error, "out_bias": error.sum(0)}
        back = (error @ w["out"].T) * (k["hidden"] > 0)
        g |= {"dense": k["pooled"].T @ back, "dense_bias": back.sum(0)}
        pooled = back @ w["dense"].T
        f = k["largest"].shape[1]
        owner = np.repeat(np.arange(len(x.first)), k["sizes"])
        largest = (k["chunks"] == k["largest"][owner]).astype(np.float32)
        largest /= np.add.reduceat(largest, x.first)[owner]
        chunk = largest * pooled[owner, :f] + (pooled[:, f:] / k["sizes"][:, None])[owner]
        chunk /= k["counts"][:, None]
        block = chunk.copy()
        np.add.at(block, x.after, np.where(k["double"], chunk, 0))
        act = np.repeat(block, _BLOCK, axis=0) * (k["act"] > 0)
        moved = np.zeros_like(act)
        moved[1:] = act[:-1]
        g |= {"left": k["rows"].T @ act, "right": k["rows"].T @ moved, "bias": act.sum(0)}
        rows = (act @ w["left"].T + moved @ w["right"].T)[:, :-1].reshape(-1, self.settings.width)
        flat = x.bytes_.reshape(-1)
        g["embed"] = np.stack(
            [np.bincount(flat, rows[:, i], minlength=256) for i in range(self.settings.width)], axis=1
        ).astype(np.float32)
        return g

    def fit(self, texts: list[str], labels: list[int]) -> ByteNetwork:
        """Adam over shuffled batches; a steady seed, so equal rows give an equal network."""
        s, draw = self.settings, np.random.default_rng(self.settings.seed)
        wanted = np.array(labels, np.float32)
        first = {n: np.zeros_like(v) for n, v in self.weights.items()}
        second = {n: np.zeros_like(v) for n, v in self.weights.items()}
        in_epoch = -(-len(texts) // s.batch)
        epochs = max(s.epochs, -(-s.least_steps // in_epoch))
        total, step = epochs * in_epoch, 0
        for _ in range(epochs):
            order = draw.permutation(len(texts))
            for at in range(0, len(order), s.batch):
                pick = order[at : at + s.batch]
                g = self.gradients(laid_out(pa.array([texts[i] for i in pick], pa.string())), wanted[pick])
                step += 1
                rate = s.rate * (1 - 0.9 * step / total)
                for name, slope in g.items():
                    first[name] = 0.9 * first[name] + 0.1 * slope
                    second[name] = 0.99 * second[name] + 0.01 * slope * slope
                    down = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
                    self.weights[name] = (self.weights[name] - rate * down).astype(np.float32)
        return self


class Constant:
    """Stands in where there is nothing to learn from: no labelled row, or all rows labelled alike."""

    def __init__(self, value: float):
        self.value = value

    def score(self, column: pa.Array) -> np.ndarray:
        return np.full(len(column), self.value)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: CRC-32 of the id as text divides by five."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learned(documents: DataFrame, labels: DataFrame, settings: Training = Training()) -> ByteNetwork | Constant:
    """Fit on a bounded sample of labelled rows that are not held out.

    The rows with the smallest hashes of their ids are taken. Null labels and ids teach nothing; a
    null text is empty.
    """
    taught = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    taught = taught.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    some = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(settings.most_rows)
    text = F.coalesce("text", F.lit(""))
    # At most most_rows narrow rows are broadcast; a label may meet several rows of one id.
    rows = (
        documents.select("doc_id", text.alias("text"))
        .where(F.octet_length("text") <= settings.most_bytes)
        .join(F.broadcast(some), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "text")
        .limit(settings.most_rows)
        .collect()
    )
    seen = {row["quality"] for row in rows}
    if len(seen) < 2:
        return Constant(float(seen.pop()) if seen else 0.5)
    return ByteNetwork(settings).fit([r["text"] for r in rows], [r["quality"] for r in rows])


def scored(frame: DataFrame, network: ByteNetwork | Constant, text: str = "text") -> DataFrame:
    """The frame with ``score``; a column of that name is replaced.

    Null and empty texts get the score of an empty text. Repeated rows stay and score alike (up to
    the rounding of sums); only the text is an input.
    """
    return appended(frame, [("score", "double")], lambda: lambda batch: [network.score(text_of(batch, text))], text)


def accepted(frame: DataFrame, network: ByteNetwork | Constant, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows that score ``least`` or more, with the frame's own columns."""
    return appended(
        frame,
        [("score", "double")],
        lambda: lambda batch: [network.score(text_of(batch, text))],
        text,
        keep=lambda made: made[0] >= least,
    )
