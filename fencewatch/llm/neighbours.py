"""Nearest neighbours by shifted Hilbert curves.

Vectors are projected at random to a few dimensions, shifted, and ordered by their place on a Hilbert
curve; each of several curves has its own projection and shift. Spark range-partitions the curves, a
running count turns the order into blocks of equal size, and a query is compared in full precision with
the vectors of its own and the neighbouring blocks. The windows of all curves are merged. The window
follows from the number of vectors: without structure, neighbours are a share of the table away on a
curve, not a number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fencewatch.sources.scratch import written


@dataclass(frozen=True)
class Curves:
    """On each of the ``count`` curves a query meets at least ``max(block, rows / share)`` vectors to either side.

    A block holds so many vectors, but at most ``most``: beyond that a query visits more blocks instead.
    """

    count: int = 16
    dimensions: int = 10
    bits: int = 6
    block: int = 2048
    share: int = 40
    most: int = 65536
    seed: int = 1


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers below 2**bits (J. Skilling's transform)."""
    axes = [column.copy() for column in cells.astype(np.int64).T]
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(len(axes)):
            high = (axes[i] & step) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(high, low, swap)
            axes[i] ^= swap
        step >>= 1
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(len(cells), np.int64)
    step = 1 << (bits - 1)
    while step > 1:
        turn ^= np.where((axes[-1] & step) != 0, step - 1, 0)
        step >>= 1
    keys = np.zeros(len(cells), np.int64)
    for bit in reversed(range(bits)):
        for axis in axes:
            keys = keys << 1 | (((axis ^ turn) >> bit) & 1)
    return keys


def curve_keys(vectors: np.ndarray, mean: np.ndarray, spread: np.ndarray, curves: Curves) -> np.ndarray:
    """(curves, rows): keys of the vectors on every curve."""
    draw = np.random.default_rng([curves.seed, vectors.shape[1]])
    n = min(curves.dimensions, vectors.shape[1])
    out = []
    for _ in range(curves.count):
        directions = np.linalg.qr(draw.normal(size=(vectors.shape[1], n)))[0]
        shift = draw.random(n) * 4
        scale = np.sqrt((directions**2 * (spread**2)[:, None]).sum(0))
        place = ((vectors - mean) @ directions) / np.where(scale > 0, scale, 1)
        cells = np.clip((place + 4 + shift) / 12, 0, 1 - 1e-9) * (1 << curves.bits)
        out.append(hilbert_keys(cells.astype(np.int64), curves.bits))
    return np.stack(out)


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def _with_keys(classes: DataFrame, curves: Curves) -> DataFrame:
    """One row for each vector and curve."""
    stats = (
        classes.select(F.size("vector").alias("size"), F.posexplode("vector").alias("at", "x"))
        .groupBy("size", "at")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"))
        .orderBy("size", "at")
        .toPandas()
    )  # as many rows as a vector has components
    scales = {int(size): (g["mean"].to_numpy(), g["spread"].to_numpy()) for size, g in stats.groupby("size")}
    names = ["curve", "key", *classes.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(rows))
                vectors = part.column(part.schema.get_field_index("vector")).flatten().to_numpy().reshape(len(rows), size)
                for number, keys in enumerate(curve_keys(vectors.astype(np.float64), *scales[size], curves)):
                    # Vectors of other lengths are on curves of their own.
                    curve = np.full(len(rows), size * curves.count + number)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(curve, pa.int64()), pa.array(keys, pa.int64()), *part.columns], names
                    )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"curve long, key long, {schema}")


def _in_blocks(keyed: DataFrame, curves: Curves) -> DataFrame:
    """Add the block that each row falls in along its curve, and how many blocks to either side a query visits."""
    order = ["curve", "key", "class_id"]
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_.withColumn("place", F.monotonically_increasing_id()), "curves")
    part = F.shiftright("place", 33).alias("part")
    counts = placed.groupBy("curve", part).agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    window = F.greatest(F.lit(curves.block), F.ceil(F.sum("rows").over(Window.partitionBy("curve")) / curves.share))
    starts = counts.select(
        "curve", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), window.alias("window")
    ).withColumn("size", F.least("window", F.lit(curves.most)))
    return (
        placed.withColumn("part", F.shiftright("place", 33))
        .join(starts, ["curve", "part"])
        .withColumn("block", F.floor((F.col("place") - F.col("first") + F.col("before")) / F.col("size")))
        .withColumn("reach", F.ceil(F.col("window") / F.col("size")))
    )


_FOUND = "query_class long, class_id long, score double, members array<long>"


#: Numbers of one product of queries and vectors.
_STEP = 1 << 22


def _nearest_of(vectors: np.ndarray, asked: np.ndarray, ids: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each vector asked for: places of the ``keep`` nearest and their distances; ties go to the smaller id.

    A product of matrices bounds the distances, up to its rounding; those that can be among the nearest are
    then computed in full.
    """
    step = max(1, _STEP // len(vectors))
    with np.errstate(over="ignore", invalid="ignore"):
        half = (vectors**2).sum(1) / 2
        for first in range(0, len(asked), step):
            some = asked[first : first + step]
            rough = half - some @ vectors.T
            last = np.partition(rough, keep - 1, axis=1)[:, keep - 1] if keep < len(vectors) else np.full(len(some), np.inf)
            last = last + 1e-10 * (half.max() + (some**2).sum(1))
            for vector, values, most in zip(some, rough, last):
                places = np.flatnonzero(~(values > most))  # all, where a bound is not a number
                score = np.sqrt(((vectors[places] - vector) ** 2).sum(1))
                near = np.lexsort((ids[places], score))[:keep]
                yield places[near], score[near]


def _compared(rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The nearest classes of each query that visits a block."""
    here = rows[~rows["visitor"]]
    visitors = rows[rows["visitor"]]
    if not len(here) or not len(visitors):
        kinds = {"query_class": "int64", "class_id": "int64", "score": "float64", "members": "object"}
        return pd.DataFrame({name: pd.Series(dtype=kind) for name, kind in kinds.items()})
    vectors = np.stack(here["vector"].to_numpy()).astype(np.float64)
    asked = np.stack(visitors["vector"].to_numpy()).astype(np.float64)
    found = list(_nearest_of(vectors, asked, here["members"].str[0].to_numpy(np.int64), keep))
    places = np.concatenate([near for near, _ in found])
    return pd.DataFrame(
        {
            "query_class": np.repeat(visitors["class_id"].to_numpy(), [len(near) for near, _ in found]),
            "class_id": here["class_id"].to_numpy()[places],
            "score": np.concatenate([score for _, score in found]),
            "members": here["members"].to_numpy()[places],
        }
    )


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, curves: Curves = Curves(), key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query among all other rows.

    The score is the Euclidean distance in double precision; ties go to the smaller id. Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do rows without id; a repeated
    row counts once, and vectors of different lengths are never compared. Equal vectors are searched
    once, with the k + 1 smallest ids that have them, so any number of copies costs no more than one.
    Other columns are not read.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("query"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("class_id", F.xxhash64("vector"))
    first = Window.partitionBy("class_id").orderBy("id")
    members = (
        rows.select("class_id", "id", "vector")
        .withColumn("n", F.dense_rank().over(first))
        .where(F.col("n") <= k + 1)
        .groupBy("class_id", "id")
        .agg(F.first("vector").alias("vector"))
        .groupBy("class_id")
        .agg(F.first("vector").alias("vector"), F.sort_array(F.collect_set("id")).alias("members"))
    )
    asked = written(rows.where(F.col("query")).select("id", "class_id").distinct(), "queries")
    flagged = members.join(asked.select("class_id").distinct().withColumn("query", F.lit(True)), "class_id", "left")
    classes = written(flagged.withColumn("query", F.coalesce("query", F.lit(False))), "vectors")

    blocks = _in_blocks(_with_keys(classes, curves), curves).select(
        "curve", "block", "reach", "class_id", "vector", "members", "query"
    )
    seen = F.sequence(F.col("block") - F.col("reach"), F.col("block") + F.col("reach"))
    visits = blocks.where("query").withColumn("block", F.explode(seen))
    together = blocks.withColumn("visitor", F.lit(False)).unionByName(visits.withColumn("visitor", F.lit(True)))
    found = (
        together.drop("query", "reach")
        .groupBy("curve", "block")
        .applyInPandas(lambda group: _compared(group, k + 1), _FOUND)
        .groupBy("query_class", "class_id")
        .agg(F.first("score").alias("score"), F.first("members").alias("members"))
    )
    best = Window.partitionBy("query_class").orderBy("score", F.col("members")[0])
    merged = (
        found.withColumn("n", F.row_number().over(best))
        .where(F.col("n") <= k + 1)
        .select("query_class", F.explode("members").alias("vec_id"), "score")
        .groupBy("query_class")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("near"))
    )
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return (
        asked.join(merged, F.col("class_id") == F.col("query_class"))
        .select(F.col("id").alias("query_id"), F.posexplode(own).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
    )
