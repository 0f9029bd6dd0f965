"""Which landed pages are asked for, decided before any of them is read.

Keys come first: the addresses that searches name, and the day of the newest snapshot of each, are narrow
columns. They go into a bitmap of hashes that every task gets, and a page whose bit is not set is left out before
its text is read or parsed. The bitmap may let a few pages through that nobody asked for; the join on
the address that follows is exact, so that its size never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.sources.scratch import written

#: Bits for each key; with one hash a key that was not asked for passes in one case of so many.
BITS_PER_KEY = 16
#: Largest bitmap that is sent to the tasks: 64 MB. With more keys nothing is left out.
MOST_BITS = 1 << 29
#: Bits of one row of a bitmap, fixed by ``bitmap_construct_agg``.
_ROW_BITS = 1 << 15


def bitmap_rows(hashes: DataFrame, bits: int) -> DataFrame:
    """``(bucket, bitmap)`` with a bit set for each ``hash``; combined in the tasks before anything is moved."""
    place = F.pmod(F.col("hash"), F.lit(bits))
    return hashes.groupBy(F.expr(f"pmod(hash, {bits}) div {_ROW_BITS}").alias("__bucket")).agg(
        F.bitmap_construct_agg(place % _ROW_BITS).alias("__bitmap")
    )


def likely_among(df: DataFrame, hash_: Column, hashes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Rows whose hash is, or may be, one of ``hashes(hash)``; a NULL hash is none. Nothing is shuffled.

    ``hashes`` is counted and read again, so it should be a stored table. Where the bitmap would be
    larger than ``most_bits``, all rows stay.
    """
    wanted = hashes.count() * BITS_PER_KEY
    bits = max(_ROW_BITS, 1 << max(wanted - 1, 0).bit_length())
    if bits > most_bits:
        return df
    place = F.pmod(hash_, F.lit(bits))
    byte = F.expr("cast(conv(hex(substring(__bitmap, cast(__place div 8 + 1 as int), 1)), 16, 10) as int)")
    placed = df.withColumn("__at", place)
    placed = placed.withColumns({"__bucket": F.expr(f"__at div {_ROW_BITS}"), "__place": F.col("__at") % _ROW_BITS})
    met = placed.join(F.broadcast(bitmap_rows(hashes, bits)), "__bucket")
    return met.where(F.getbit(byte, (F.col("__place") % 8).cast("int")) == 1).select(*df.columns)


def asked_snapshots(pages: DataFrame, links: DataFrame, unique: bool = False, most_bits: int = MOST_BITS) -> DataFrame:
    """Pages ``(url, html[, fetched_at])`` at the addresses in ``links(link_url)``, of each the newest, and few others.

    Only addresses and days are read to find out which. With ``unique`` the caller vouches for one
    snapshot per address, and addresses alone decide.
    """
    asked = links.where(F.col("link_url").isNotNull()).select(F.col("link_url").alias("url")).distinct()
    asked = written(asked, "asked-links")
    if unique or "fetched_at" not in pages.columns:
        hashes = asked.select(F.xxhash64("url").alias("hash"))
        return likely_among(pages, F.xxhash64("url"), hashes, most_bits)
    found = pages.select("url", "fetched_at").join(asked, "url", "left_semi")
    newest = found.groupBy("url").agg(F.max("fetched_at").alias("fetched_at"))
    hashes = written(newest.select(F.xxhash64("url", "fetched_at").alias("hash")), "newest-asked")
    return likely_among(pages, F.xxhash64("url", "fetched_at"), hashes, most_bits)
