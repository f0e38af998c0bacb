"""Token counts: whole texts are encoded in Arrow batches that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import carried, keyed
from .segments import segmented

OUTPUTS = ["n_bytes", "n_tokens", "over_limit"]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, text_col: str = "text") -> DataFrame:
    """The documents with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Counts are those of the tokenizers library for the file `tokenizer`, without
    added begin and end tokens; a null text counts as empty (zero and zero).
    Input columns named like an output are replaced, all others are kept.

    Nothing is shuffled and only a number per row comes back from Python.  Arrow
    batches are bounded by bytes (session option), inside them the work goes by
    batches of equal characters, and long texts are cut at safe boundaries.
    """
    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = segmented(tokenizer, True)
        for batch in batches:
            yield pa.array(encoder.encode(batch.to_pylist()), pa.int64())

    rows = keyed(docs, docs.columns[0], text_col).withColumn("n_tokens", lengths("_text"))
    return rows.select(
        *carried(docs, text_col, OUTPUTS), F.octet_length(F.coalesce("_text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
