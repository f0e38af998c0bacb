"""Line dedup: lines found in many documents leave every document.

Lines are exploded as normalised keys, hashed, counted once per document, and
the keys at or over the threshold are joined back to line positions; the text
is then put together again from the positions that remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, carried, keyed, lower_ascii

OUTPUTS = ["n_lines", "n_dropped"]


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    """128 bits: a collision would drop lines that are not frequent."""
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit("line"), key).alias("_h2")]


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_documents: int = 10, min_code_points: int = 1) -> DataFrame:
    """The documents with frequent lines removed, and the columns n_lines and n_dropped.

    A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased.  Keys of at least `min_code_points` found in at least
    `min_documents` rows lose their lines in all rows.  A null or empty text is
    one empty line and its result is the empty text; each row counts as one
    document, so repeated rows count repeatedly and are kept.  Input columns
    named n_lines or n_dropped are replaced, all others are kept.

    Only 16-byte keys are counted, with a partial count before the shuffle, so a
    line of every document is one row per task.  The text itself moves once, in
    the join with its own dropped positions.  Nothing is broadcast by hint.
    """
    rows = keyed(docs, id_col, text_col).withColumn("_hash", F.xxhash64("_text"))
    lines = F.split(F.coalesce("_text", F.lit("")), "\n")
    long_enough = F.char_length("_key") >= F.lit(max(min_code_points, 0))

    frequent = (rows.select(F.explode(F.array_distinct(F.transform(lines, line_key))).alias("_key"))
                .where(long_enough).select(*_hashes(F.col("_key")))
                .groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_documents)
                .drop("_n"))
    positions = (rows.select("_id", "_hash", F.posexplode(lines).alias("_pos", "_line"))
                 .select("_id", "_hash", "_pos", line_key(F.col("_line")).alias("_key"))
                 .where(long_enough).select("_id", "_hash", "_pos", *_hashes(F.col("_key"))))
    dropped = (positions.join(frequent, ["_h1", "_h2"], "left_semi")
               .groupBy("_id", "_hash").agg(F.collect_set("_pos").alias("_dropped"))
               .select(F.col("_id").alias("_did"), F.col("_hash").alias("_dhash"), "_dropped"))

    joined = rows.join(dropped, F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_hash") == F.col("_dhash")), "left")
    parts = joined.withColumn("_lines", lines)
    kept_positions = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    kept = F.when(F.col("_dropped").isNull(), F.coalesce("_text", F.lit(""))).otherwise(
        F.array_join(F.transform(kept_positions, lambda p: F.get("_lines", p)), "\n"))
    return parts.select(
        kept.alias("_text"), "_row", F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    ).select(*carried(docs, text_col, OUTPUTS), *OUTPUTS)
