"""Label expressions over severities, finding types and confidences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import fixed
from .text import strip_ws


def choose(col: Column, table: dict) -> Column:
    """Value of a small fixed table by key, null for other keys."""
    picked = None
    for key, value in table.items():
        picked = F.when(col == key, value) if picked is None else picked.when(col == key, value)
    return picked


def severity_score(severity: Column) -> Column:
    return choose(severity, fixed.SEVERITY_SCORES)


def severity_of(score: Column) -> Column:
    return choose(score, {v: k for k, v in fixed.SEVERITY_SCORES.items()})


def type_key(finding_type: Column) -> Column:
    """Key under which a reply finding counts as already covered."""
    return F.substring(F.replace(F.lower(finding_type), F.lit(" "), F.lit("")), 1, 24)


def infer_owasp(finding_type: Column) -> Column:
    lowered = F.lower(finding_type)
    cases = [(F.contains(lowered, F.lit(word)), category) for word, category in fixed.OWASP_KEYWORDS]
    first, rest = cases[0], cases[1:]
    return reduce(lambda acc, case: acc.when(*case), rest, F.when(*first))


def fill_owasp(owasp: Column, finding_type: Column) -> Column:
    """Keep a given category, even an empty one; infer only where there is none."""
    return F.coalesce(owasp, infer_owasp(finding_type))


def owasp_short(owasp: Column) -> Column:
    short = strip_ws(F.element_at(F.split(owasp, "–", -1), 1))
    return F.when(F.coalesce(owasp, F.lit("")) == "", "—").otherwise(short)


def rule_id(finding_type: Column) -> Column:
    slug = F.translate(F.replace(F.upper(finding_type), F.lit(" "), F.lit("-")), "()", "")
    return F.concat(F.lit(fixed.RULE_ID_PREFIX), F.substring(slug, 1, 40))


def rule_name(finding_type: Column) -> Column:
    return F.replace(finding_type, F.lit(" "), F.lit(""))


def sarif_level(severity: Column) -> Column:
    return choose(severity, fixed.SARIF_LEVELS)


def security_severity(severity: Column) -> Column:
    return choose(severity, fixed.SARIF_SECURITY_SEVERITY)


def precision(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, "high").otherwise("medium")

