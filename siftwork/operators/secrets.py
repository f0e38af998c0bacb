"""Hardcoded-secret detection with per-line regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.text import split_lines
from ..schema import MAX_PATTERNS, STAGE_SECRET, SUB_BITS, stage_base
from .static_rows import static_rows


@dataclass(frozen=True)
class SecretPattern:
    """A regular expression (Java syntax) searched in every line.

    `needs` are cheaper tests, first one cheapest, that every text with a hit
    passes: plain words or regular expressions.  Left out, the pattern itself is
    tried on the whole text where that is safe.
    """

    pattern: str
    type: str
    severity: str
    needs: tuple[str, ...] | None = None


_SPACE = r"[\s\x1C-\x1F]"
# Letters that also fold to the given ASCII letter.
_FOLDS = {"s": "\u017f", "k": "\u212a", "i": "\u0130\u0131"}
# Every keyword of the assignment patterns ends in d, y or n.
_ASSIGNED_TEXT = rf"""(?U)[dDyYnN]{_SPACE}*={_SPACE}*["']"""


def _builtin(pattern: str, kind: str, severity: str) -> SecretPattern:
    """A fixed pattern in Java syntax, with its cheap tests.

    Case folding and white space follow Unicode, and white space includes the
    ASCII separators, as in the dialect the fixed patterns are written in.
    """
    java = "(?U)" + pattern.replace(r"\s", _SPACE)
    if pattern.startswith("(?i)"):
        # Letter classes run several times faster than case-insensitive matching.
        keywords = pattern[len("(?i)"):pattern.index(r"\s*=")]
        classes = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}{_FOLDS.get(m[0], '')}]", keywords)
        return SecretPattern(java, kind, severity, (_ASSIGNED_TEXT, f"(?U){classes}{_SPACE}*="))
    literal = re.match(r"[-\w ]+", pattern)[0]
    return SecretPattern(java, kind, severity, (literal, java))


BUILTIN_PATTERNS = tuple(_builtin(*fixed_pattern) for fixed_pattern in fixed.SECRET_PATTERNS)

_POSITION_SENSITIVE = re.compile(r"\^|\$|\\[bBAZzGQ]|\(\?[=!<>]|[+*?}]\+|\\[Rr]")


def _may_prefilter(pattern: str) -> bool:
    """True when a hit in a line implies a hit in the whole text.

    That holds unless the pattern looks at its surroundings (anchors, word
    boundaries, look-around) or refuses to backtrack.  A caret right after an
    opening bracket only negates a class.
    """
    return not _POSITION_SENSITIVE.search(pattern.replace("[^", "["))


def _check(patterns) -> list[SecretPattern]:
    patterns = list(patterns)
    if not 0 < len(patterns) <= MAX_PATTERNS:
        raise ValueError(f"between 1 and {MAX_PATTERNS} patterns are supported")
    return patterns


def patterns_from_table(table: DataFrame) -> list[SecretPattern]:
    """Patterns of a small table (pattern_idx, pattern, type, severity), in index order.

    Patterns become literal predicates, so the table is a parameter: one with
    more rows than a scan supports is refused, never cut.
    """
    rows = table.select("pattern_idx", "pattern", "type", "severity").orderBy("pattern_idx").limit(MAX_PATTERNS + 1)
    return _check(SecretPattern(row["pattern"], row["type"], row["severity"]) for row in rows.collect())


def _needs(pattern: SecretPattern) -> tuple[str, ...]:
    if pattern.needs is not None:
        return pattern.needs
    return (pattern.pattern,) if _may_prefilter(pattern.pattern) else ()


def _passes(text: Column, need: str) -> Column:
    return F.contains(text, F.lit(need)) if re.fullmatch(r"[-\w ]+", need) else text.rlike(need)


def text_may_hit(text: Column, patterns=BUILTIN_PATTERNS) -> Column | None:
    """A test on the whole text that no text with a hit fails, or None.

    Patterns that share their cheapest test share its evaluation.
    """
    by_first: dict[str, list] = {}
    for needs in map(_needs, _check(patterns)):
        if not needs:
            return None
        by_first.setdefault(needs[0], []).append(needs[1:])
    groups = []
    for first, rests in by_first.items():
        test = _passes(text, first)
        if all(rests):
            test = test & reduce(or_, [reduce(and_, [_passes(text, n) for n in rest]) for rest in rests])
        groups.append(test)
    return reduce(or_, groups)


def _line_hits(line: Column, patterns: list[SecretPattern], first_of_type: bool = False) -> Column:
    """Indexes of the patterns found in a line, one literal regex per pattern.

    With `first_of_type`, of patterns that share a type only the first counts; each
    pattern still runs once, and the plan grows with the number of patterns.
    """
    hits = F.array_compact(F.array(*[F.when(line.rlike(p.pattern), F.lit(i)) for i, p in enumerate(patterns)]))
    kinds = list(dict.fromkeys(p.type for p in patterns))
    if not first_of_type or len(kinds) == len(patterns):
        return hits
    kind_of = F.array(*[F.lit(kinds.index(p.type)) for p in patterns])
    kind = lambda i: F.get(kind_of, i)
    return F.aggregate(hits, F.array().cast("array<int>"), lambda kept, i: F.when(
        F.exists(kept, lambda k: kind(k) == kind(i)), kept).otherwise(F.array_append(kept, i)))


def hit_codes(text: Column, patterns=BUILTIN_PATTERNS) -> Column:
    """Array of `line_number << SUB_BITS | pattern index` of a text, once per line and type.

    The cheap test runs on the text and again on each of its lines, so the
    patterns themselves see few lines.
    """
    patterns = _check(patterns)
    nothing = F.array().cast("array<bigint>")

    def if_may_hit(part: Column, codes: Column) -> Column:
        guard = text_may_hit(part, patterns)
        return codes if guard is None else F.when(guard, codes).otherwise(nothing)

    def codes_of(line: Column, i: Column) -> Column:
        at = F.shiftleft((i + 1).cast("bigint"), SUB_BITS)
        return if_may_hit(line, F.transform(
            _line_hits(line, patterns, first_of_type=True), lambda p: at.bitwiseOR(p.cast("bigint"))))
    return if_may_hit(text, F.flatten(F.transform(split_lines(text), codes_of)))


def explode_lines(files: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per line of each text, numbered from 1."""
    return (files.select(*keys, F.posexplode(split_lines(F.col(text))).alias("_pos", "line"))
            .select(*keys, (F.col("_pos") + 1).cast("bigint").alias("line_number"), "line"))


def secret_hits(files: DataFrame, *keys: str, patterns=BUILTIN_PATTERNS, text: str = "text",
                first_of_type: bool = False) -> DataFrame:
    """One row per (text, line, pattern) hit.

    Texts that cannot hit are dropped before lines are exploded, and lines before
    patterns are tried; patterns are unrolled into literal predicates rather
    than joined to the lines.
    """
    patterns = _check(patterns)

    def that_may_hit(df: DataFrame, column: str) -> DataFrame:
        guard = text_may_hit(F.col(column), patterns)
        return df if guard is None else df.where(guard)
    return (explode_lines(that_may_hit(files, text), *keys, text=text)
            .transform(that_may_hit, "line")
            .select(*keys, "line_number", F.explode(_line_hits(F.col("line"), patterns, first_of_type))
                    .alias("pattern_idx")))


def secret_message(patterns=BUILTIN_PATTERNS) -> dict[str, Column]:
    """Label and text columns of a narrow row (pattern_idx)."""
    at = F.col("pattern_idx") + 1
    kind = F.element_at(F.array(*[F.lit(p.type) for p in patterns]), at)
    return {
        "severity": F.element_at(F.array(*[F.lit(p.severity) for p in patterns]), at),
        "type": kind,
        "description": F.replace(F.lit(fixed.SECRET_DESCRIPTION), F.lit("{type}"), kind),
        "impact": F.lit(fixed.SECRET_IMPACT),
        "fix": F.lit(fixed.SECRET_FIX),
        "confidence": F.lit(fixed.SECRET_CONFIDENCE),
    }


def describe_hits(hits: DataFrame, *keys: str, patterns=BUILTIN_PATTERNS) -> DataFrame:
    """Findings of (line_number, pattern_idx) rows."""
    ordinal = F.lit(stage_base(STAGE_SECRET)) + F.shiftleft("line_number", SUB_BITS) + F.col("pattern_idx")
    return static_rows(hits.withColumn("ordinal", ordinal), secret_message(_check(patterns)), *keys)


def line_of(code: Column) -> Column:
    return F.shiftright(code, SUB_BITS)


def pattern_of(code: Column) -> Column:
    return code.bitwiseAND(F.lit(MAX_PATTERNS - 1)).cast("int")


def describe_codes(hits: DataFrame, *keys: str, patterns=BUILTIN_PATTERNS) -> DataFrame:
    """Findings of rows holding one hit code each."""
    narrow = hits.select(*keys, line_of(F.col("code")).alias("line_number"), pattern_of(F.col("code")).alias("pattern_idx"))
    return describe_hits(narrow, *keys, patterns=patterns)


def secret_findings(files: DataFrame, *keys: str, patterns=BUILTIN_PATTERNS, text: str = "text") -> DataFrame:
    """Secret findings of any text, one per (key, type, line).

    Keys are unique per text, so first-wins is decided inside a line and the
    whole job is a scan without a shuffle.
    """
    return describe_hits(secret_hits(files, *keys, patterns=patterns, text=text, first_of_type=True),
                         *keys, patterns=patterns)
