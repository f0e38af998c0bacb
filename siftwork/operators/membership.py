"""A filter of bounded size for the keys that a large table is about to be joined by.

An exact join moves every row of the large table or broadcasts all keys.  The filter is a bitmap over
hashes of the keys: every row whose key is wanted passes it and few others do, it costs no shuffle of
the large side, and its size is bounded whatever the number of keys.  An exact join of what
comes out, by then narrow, makes the result right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of one bitmap (fixed by Spark's bitmap functions) and the most bitmaps of a filter: 4 KB to 32 MB.
BITMAP_BITS, MOST_BITMAPS = 32_768, 8_192
#: Bits per key, as long as the bound allows: about one unwanted row in sixteen passes.
BITS_PER_KEY = 16


def _place(bitmaps: int, on: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(bitmaps * BITMAP_BITS))


def _bitmap(place: Column) -> Column:
    return F.floor(place / BITMAP_BITS).cast("int")


def bitmaps_for(count: int) -> int:
    return min(MOST_BITMAPS, max(1, -(-count * BITS_PER_KEY // BITMAP_BITS)))


def key_filter(keys: DataFrame, bitmaps: int, *on: str) -> DataFrame:
    """(_bitmap, _bits) over the values of `on`: at most `bitmaps` rows of 4 KB."""
    place = _place(bitmaps, on)
    return (keys.select(_bitmap(place).alias("_bitmap"), (place % BITMAP_BITS).alias("_bit"))
            .groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits")))


def that_may_match(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows of `rows` whose values of `on` may be among those of `keys`: all that are, and few others.

    `keys` is counted and read once more, so it should be a written table.  The side that is
    broadcast has 32 MB at most; with more keys than that serves, more unwanted rows pass and none
    is lost.  Nulls match nulls.
    """
    bitmaps = bitmaps_for(keys.count())
    placed = rows.withColumn("_place", _place(bitmaps, on)).withColumn("_bitmap", _bitmap(F.col("_place")))
    is_set = F.expr(f"""(CAST(conv(hex(substring(_bits, CAST((_place % {BITMAP_BITS}) div 8 AS INT) + 1, 1)), 16, 10) AS INT)
                         & shiftleft(1, CAST(_place % 8 AS INT))) <> 0""")
    return placed.join(F.broadcast(key_filter(keys, bitmaps, *on)), "_bitmap").where(is_set).select(*rows.columns)
