"""Order of findings inside a file, computed without gathering a file in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise, shuffle_width


def worst_first() -> list[Column]:
    """Severity, then confidence, then arrival: the order findings are reported in."""
    return [F.col("severity_score").desc(), F.col("confidence").desc(), F.col("ordinal").asc()]


def sort_findings(findings: DataFrame, *keys: str) -> DataFrame:
    """Global order by key, then worst first.  A range sort on the whole order
    key, so a file with very many findings spans several partitions."""
    return findings.orderBy(*keys, *worst_first())


def rank_in_file(findings: DataFrame, *keys: str) -> DataFrame:
    """Adds `rank_in_file`, the 1-based position of a finding within its key (without keys: of all).

    A plain window over the key would put a whole file in one task.  Here the whole order
    (keys, then worst first) is cut into ranges, so a file with very many findings spans several;
    rows are numbered within a range, and a file's ranges, one row each, tell how many rows
    stand in front.  Ranges are written once, so their borders are the same for both.  Null keys are a
    file of their own, null ordinals come first.
    """
    ranged = findings.repartitionByRange(shuffle_width(findings.sparkSession), *keys, *worst_first())
    ranged = materialise(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    cell = [*keys, "_range"]
    sizes = ranged.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    in_front = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"_at{i}") for i, c in enumerate(cell)],
                           F.coalesce(F.sum("_n").over(in_front), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*cell).orderBy(*worst_first()))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_at{i}")) for i, c in enumerate(cell)])
    return (ranged.withColumn("_within", within).join(offsets, same)
            .select(*findings.columns, (F.col("_before") + F.col("_within")).alias("rank_in_file")))


def with_position(ordered: DataFrame) -> DataFrame:
    """Adds `position`, the 1-based place of each row of an ordered table, by the rows of each of its partitions."""
    placed = ordered.withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_part", F.shiftright("_at", 33)), "positions")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    in_front = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(in_front), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(offsets, "_part").select(*ordered.columns, place.alias("position"))
