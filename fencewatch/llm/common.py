"""Helpers that several corpus operators share: tables, bounded batches, words and hashes in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencewatch.operators.lookup import bitmap_rows

#: Text bytes that one step in a task looks at together; a longer text is a step of its own.
STEP_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of text, never part of a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = flat_text(batch.column(batch.schema.get_field_index(text)))[1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each text starts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return data, offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    return [value or "" for value in column.to_pylist()]


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are one of the six blanks that part words."""
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one entry more at the end)."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~is_space(data)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (the finalizer of MurmurHash3)."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers.append(np.cumprod(row, dtype=np.uint64))
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial from one running sum, then mixed."""
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def as_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [column if isinstance(column, pa.Array) else pa.array(column, field.type) for column, field in zip(columns, schema)],
        schema=schema,
    )


def appended(
    frame: DataFrame,
    fields: list[tuple[str, str]],
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    text: str = "text",
    keep: Callable[[list], np.ndarray] | None = None,
) -> DataFrame:
    """The frame with more columns that a function makes from batches of whole rows.

    ``make`` is called once per task and gives the function; that one returns one array per field.
    Columns of the frame that have a field's name are replaced. With ``keep`` only rows stay for which
    it is true of the arrays, and the fields themselves are left out.
    """
    names = {name.lower() for name, _ in fields} if keep is None else set()
    kept = [field for field in frame.schema.fields if field.name.lower() not in names]
    described = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    added = [f"`{name}` {kind}" for name, kind in fields] if keep is None else []
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in steps(batches, text):
            made = work(batch)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            if keep is not None:
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept]).filter(pa.array(keep(made)))
                continue
            columns += [pa.array(values, types[kind]) for values, (_, kind) in zip(made, fields)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + [name for name, _ in fields])

    return frame.mapInArrow(run, ", ".join(described + added))


def text_of(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(text))


#: Bits of a key filter for each key, and of the largest filter: 64 MB.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 29


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap with a bit set for each long in the frame's only column, as bytes; sized by the number of keys.

    It says "certainly not there" or "perhaps there". What passes still goes through an exact join, so that a bitmap that
    would have to be larger than allowed, and is fuller instead, costs speed and never changes a result. Keys are
    counted and read again: they should be a stored table.
    """
    wanted = keys.count() * FILTER_BITS
    bits = min(max(1 << 15, 1 << max(wanted - 1, 0).bit_length()), MOST_FILTER_BITS)
    made = np.zeros(bits // 8, np.uint8)
    for row in bitmap_rows(keys.select(F.col(keys.columns[0]).alias("hash")).dropna(), bits).collect():
        part = np.frombuffer(row["__bitmap"], np.uint8)
        made[row["__bucket"] * len(part) : (row["__bucket"] + 1) * len(part)] = part
    return made


def perhaps_there(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = np.ascontiguousarray(keys).view(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 != 0


def filtered_by(frame: DataFrame, bitmap: np.ndarray, key: str, there: bool) -> DataFrame:
    """The rows whose key is perhaps (or certainly not) among the filter's; null keys are never among them."""
    shared = frame.sparkSession.sparkContext.broadcast(bitmap)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(key))
            hit = perhaps_there(shared.value, column.fill_null(0).to_numpy(zero_copy_only=False))
            hit &= column.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(hit if there else ~hit))

    return frame.mapInArrow(run, schema)
