"""Saved model replies to typed findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions import labels
from ..functions.text import extract_field, parse_line, parse_severity, split_blocks, strip_ws
from ..schema import STAGE_REPLY, SUB_BITS, finding_rows, stage_base


def _failed():
    return F.col("error").isNotNull() | F.col("response_text").isNull()


def _without_findings():
    return F.contains(F.upper("response_text"), F.lit(fixed.REPLY_NONE_SENTINEL))


def reply_blocks(replies: DataFrame, *keys: str) -> DataFrame:
    """Non-empty blocks of usable replies, with their position in the reply."""
    usable = replies.where(~_failed()).where(~_without_findings())
    return (usable.select(*keys, F.posexplode(split_blocks(F.col("response_text"))).alias("block_idx", "block"))
            .withColumn("block", strip_ws(F.col("block")))
            .where("block <> ''"))


def _ordinal():
    return F.lit(stage_base(STAGE_REPLY)) + F.shiftleft(F.col("block_idx").cast("bigint"), SUB_BITS)


def reply_findings(replies: DataFrame, *keys: str) -> DataFrame:
    """Findings of model replies (`response_text`, `error`), from one pass.

    A usable reply gives one finding per block that names both a severity and a
    type; a failed or missing reply gives one INFO finding.
    """
    nothing = F.array().cast("array<string>")
    blocks = (F.when(_failed(), F.array(F.lit(None).cast("string")))
              .when(_without_findings(), nothing)
              .otherwise(split_blocks(F.col("response_text"))))
    each = replies.select(*keys, "error", _failed().alias("_failed"),
                          F.posexplode(blocks).alias("block_idx", "block"))
    fields = each.select(
        *keys, "error", "_failed", _ordinal().alias("ordinal"),
        *[extract_field(strip_ws(F.col("block")), name).alias(f"_{name.lower()}") for name in fixed.REPLY_FIELDS])
    kept = fields.where("_failed or (_severity <> '' and _type <> '')")

    def either(of_failure, of_block):
        return F.when(F.col("_failed"), of_failure).otherwise(of_block)
    typed = kept.select(
        *keys, "ordinal",
        either(F.lit("INFO"), parse_severity(F.col("_severity"))).alias("severity"),
        either(F.lit(fixed.REPLY_ERROR_TYPE), F.col("_type")).alias("type"),
        either(F.concat(F.lit(fixed.REPLY_ERROR_DESCRIPTION_PREFIX), F.coalesce("error", F.lit("empty reply"))),
               F.col("_description")).alias("description"),
        either(F.lit(fixed.REPLY_ERROR_IMPACT), F.col("_impact")).alias("impact"),
        either(F.lit(fixed.REPLY_ERROR_FIX), F.col("_fix")).alias("fix"),
        either(F.lit(None), parse_line(F.col("_line"))).alias("line_number"),
        either(F.lit(1.0), F.lit(fixed.REPLY_CONFIDENCE)).alias("confidence"))
    labelled = typed.select(
        "*",
        labels.severity_score(F.col("severity")).alias("severity_score"),
        labels.infer_owasp(F.col("type")).alias("owasp"),
        F.lit("llm").alias("source"))
    return finding_rows(labelled, *keys)


def parse_replies(replies: DataFrame, *keys: str) -> DataFrame:
    """Findings of usable replies only."""
    return reply_findings(replies.where(~_failed()), *keys)


def reply_errors(replies: DataFrame, *keys: str) -> DataFrame:
    """Failed or missing replies only, as one INFO finding each."""
    return reply_findings(replies.where(_failed()), *keys)
