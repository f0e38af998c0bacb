"""Path expressions: suffix, language, scan scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed


def file_suffix(path: Column) -> Column:
    """Lower-cased last suffix of the file name; dotfiles and trailing dots have none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def detect_language(path: Column) -> Column:
    suffix = file_suffix(path)
    named = F.lit("Unknown")
    by_suffix = F.create_map(*[F.lit(v) for pair in fixed.SUFFIX_LANGUAGES.items() for v in pair])
    return F.coalesce(F.try_element_at(by_suffix, suffix), named)


def is_scannable(path: Column, suffixes=tuple(fixed.SUFFIX_LANGUAGES)) -> Column:
    return file_suffix(path).isin(*suffixes)


def in_skip_dir(relative_path: Column, skip_dirs=fixed.SKIP_DIRS) -> Column:
    """True when any component of a path relative to the scan root is skipped."""
    return F.arrays_overlap(F.split(relative_path, "/"), F.array(*[F.lit(d) for d in skip_dirs]))


def with_language_table(files: DataFrame, languages: DataFrame) -> DataFrame:
    """Language by joining a (suffix, language) table instead of the fixed map.

    The table has one row per suffix.  It carries no hint: Spark broadcasts it
    when its measured size is below the session's threshold and shuffles
    otherwise.
    """
    return (files.withColumn("suffix", file_suffix(F.col("file_path")))
            .join(languages, "suffix", "left")
            .withColumn("language", F.coalesce("language", F.lit("Unknown")))
            .drop("suffix"))
