"""Joins and first-row selection that stay balanced under hot keys.

Any key may hold a large share of all rows: one content copied to millions of
paths, one file with most of the findings.  The helpers split such a key over
many tasks without sampling or dropping anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SPREAD_BUCKETS = 4096


def first_wins(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order; null keys form groups of their own.

    `row_number() = 1` makes Spark keep one row per key on the map side before
    the shuffle, so a hot key ships at most one row per input task.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def _splits_by_itself(df: DataFrame) -> bool:
    """Does the session split hot partitions of joins while they run?"""
    conf = df.sparkSession.conf
    return conf.get("spark.sql.adaptive.enabled") == "true" and conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str,
                spread_by: list[str], buckets: int = SPREAD_BUCKETS) -> DataFrame:
    """Join a left side with hot keys to a right side without them.

    With adaptive execution this is a plain join: Spark splits the partitions of a
    hot key by their measured size.  In sessions without it, such as streams with
    stateful operators, the split is made here.  Left rows are split over (key, bucket of `spread_by`); right rows are copied
    only to the buckets in which their key really occurs.  A key held by a
    single left row is copied once, so ordinary keys cost nothing extra, and the
    copies never outnumber the left rows.  The (key, bucket) pairs are
    de-duplicated on the map side before they are shuffled.
    """
    if _splits_by_itself(left):
        return left.join(right.select(*on) if how in ("left_semi", "left_anti") else right, on, how)
    spread = left.withColumn("_spread", F.pmod(F.xxhash64(*spread_by), F.lit(buckets)).cast("int"))
    present = spread.select(*on, "_spread").distinct()
    if how in ("left_semi", "left_anti"):
        copied = present.join(right.select(*on), on, "left_semi")
    else:
        copied = present.join(right, on, "inner")
    return spread.join(copied, [*on, "_spread"], how).drop("_spread")
