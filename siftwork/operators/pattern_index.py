"""Very many line patterns at once: an index of literals every hit must contain, then the patterns themselves.

From each pattern the longest text that no hit can be without is taken.  One automaton over these
literals reads a text once, whatever their number, and names the few patterns that can be hits
in each line; only these are tried with the pattern, in the JVM.  Patterns without such a literal are
tried on every line, as a scan with few patterns does.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .. import fixed
from ..schema import STAGE_SECRET, SUB_BITS, stage_base
from .secrets import SecretPattern, _check, _may_prefilter, secret_hits, secret_message
from .skew import first_wins
from .static_rows import static_rows

# Workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_FACTOR = 3
#: Rows leave the index in batches of about this size; a row counts with its overhead.
BATCH_BYTES, ROW_BYTES = 4 << 20, 200
#: Bits of a place in a line.
PLACE_BITS = 32
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Characters that end a line (as `split_lines` has it); no factor spans lines.
LINE_ENDS = frozenset("\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")


def lowered(text: str) -> str:
    """A-Z lower-cased; no position moves."""
    return text.lower() if text.isascii() else text.translate(UPPER)


def bare(line: str) -> str:
    """A line without its own end."""
    return line[:-2] if line.endswith("\r\n") else line[:-1] if line[-1:] in LINE_ENDS else line


def _skipped(pattern: str, at: int) -> int | None:
    """The position after the class or group that opens at `at`; None where its end is not plain."""
    closing, depth = {"[": "]", "(": ")"}[pattern[at]], 0
    inner = at
    while inner < len(pattern):
        c = pattern[inner]
        if c == "\\":
            inner += 2
            continue
        if pattern[at] == "(" and c == "[":
            inner = _skipped(pattern, inner)
            if inner is None:
                return None
            continue
        if c == pattern[at]:
            depth += 1
            # A bracket right behind an opening one may stand for itself.
            if c == "[" and pattern[inner + 1:inner + 2] == "]" or c == "[" and pattern[inner + 1:inner + 3] == "^]":
                return None
        elif c == closing:
            depth -= 1
            if not depth:
                return inner + 1
        inner += 1
    return None


def _literal_runs(pattern: str) -> list[str] | None:
    """The literals outside groups and classes that every hit contains, the first one at the hit's very start; None in doubt."""
    if pattern.startswith("(?i)"):
        pattern = pattern[4:]
    if "\\Q" in pattern or "\\E" in pattern:
        return None
    runs, run, at = [], "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "|":
            return None
        if c in "*?{":
            runs.append(run[:-1])
            run = ""
            if c == "{":
                at = pattern.find("}", at)
                if at < 0:
                    return None
        elif c in "([":
            if c == "(" and pattern[at + 1:at + 2] == "?" and pattern[at + 2:at + 3] not in (":", "=", "!", "<", ">"):
                return None  # flags change what follows
            runs.append(run)
            run, end = "", _skipped(pattern, at)
            if end is None:
                return None
            at = end - 1
        elif c in "+.^$":
            runs.append(run)
            run = ""
        elif c == "\\":
            c = pattern[at + 1:at + 2]
            if not c or c in "xupPkcN" or c.isdigit():
                return None
            at += 1
            if c.isalpha():
                runs.append(run)
                run = ""
            else:
                run += c
        else:
            run += c
        at += 1
    return [*runs, run]


def required_factor(pattern: str) -> str | None:
    """The longest literal (lower-cased) that every hit of a Java pattern contains, or None if none is certain.

    Only what stands outside groups, classes and alternatives counts, and nothing that a quantifier may leave out.
    Where the syntax leaves any doubt there is no factor; that costs time, never a hit.
    """
    best = max(_literal_runs(pattern) or [""], key=len)
    return lowered(best) if len(best) >= LEAST_FACTOR and not LINE_ENDS & set(best) else None


def starts_with_factor(pattern: str) -> bool:
    """True when every hit of a pattern with a factor starts with it and depends on nothing in front of it."""
    runs = _literal_runs(pattern)
    return bool(runs) and runs[0] == max(runs, key=len) and _may_prefilter(pattern)


def candidate_lines(files: DataFrame, *keys: str, factors: list[str], text: str = "text") -> DataFrame:
    """(keys, line_number, line, held) of the lines that hold a factor; `held` has `factor << PLACE_BITS | place` of each in the line.

    The place is that of its first character where it stands first, from 0.

    A line leaves once, however many patterns it may hit, and without the text it stands in; rows leave
    in batches of bounded size, whatever the size of a text and the number of its candidates.
    """
    schema = StructType([files.schema[k] for k in keys] + [
        StructField("line_number", LongType()), StructField("line", StringType()), StructField("held", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, factor in enumerate(factors):
            automaton.add_word(factor, (number, (number << PLACE_BITS) - len(factor) + 1))
        automaton.make_automaton()

        def found(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str, Collection[int]]]:
            for row, value in enumerate(batch.column(len(keys))):
                # No factor spans lines, so each is searched by itself.
                for number, line in enumerate((value.as_py() or "").splitlines(keepends=True), 1):
                    held = {}
                    for end, (factor, base) in automaton.iter(lowered(line)):
                        if factor not in held:
                            held[factor] = base + end
                    if held:
                        yield row, number, bare(line), held.values()

        def rows_of(batch: pa.RecordBatch, rows: list[tuple], held: array) -> pa.RecordBatch:
            at, numbers, lines, ends = zip(*rows)
            taken = [column.take(pa.array(at, pa.int64())) for column in batch.columns[:len(keys)]]
            lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(held, pa.int64()))
            return pa.RecordBatch.from_arrays([*taken, pa.array(numbers, pa.int64()), pa.array(lines, pa.string()), lists], names=schema.names)

        for batch in batches:
            rows, held, size = [], array("q"), 0
            for row, number, line, numbers in found(batch):
                held.extend(numbers)
                rows.append((row, number, line, len(held)))
                size += ROW_BYTES + len(line) + 8 * len(numbers)
                if size >= BATCH_BYTES:
                    yield rows_of(batch, rows, held)
                    rows, held, size = [], array("q"), 0
            if rows:
                yield rows_of(batch, rows, held)

    return files.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)


def indexed_hits(files: DataFrame, *keys: str, patterns: list[SecretPattern], text: str = "text") -> DataFrame:
    """One row (keys, line_number, pattern_idx) per line and pattern found in it; equal to `secret_hits`.

    The patterns are a parameter of bounded number, sent to every task; plan and work grow with the pairs
    that can be hits, not with lines times patterns, and no line is shuffled.
    """
    patterns = _check(patterns)
    spark, factors, rest = files.sparkSession, {}, []
    for i, pattern in enumerate(patterns):
        factor = required_factor(pattern.pattern)
        if factor is None:
            rest.append(i)
        else:
            factors.setdefault(factor, []).append(i)
    parts = []
    if factors:
        rows = [(number, i, patterns[i].pattern, starts_with_factor(patterns[i].pattern))
                for number, indexes in enumerate(factors.values()) for i in indexes]
        table = spark.createDataFrame(rows, "_factor int, pattern_idx int, pattern string, _at_start boolean")
        pairs = (candidate_lines(files, *keys, factors=list(factors), text=text)
                 .select(*keys, "line_number", "line", F.explode("held").alias("_held"))
                 .withColumn("_factor", F.shiftright("_held", PLACE_BITS).cast("int")))
        # What stands in front of the first place where a hit can start need not be searched.
        place = F.col("_held").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        searched = F.when(F.col("_at_start"), F.substr("line", place + 1)).otherwise(F.col("line"))
        parts.append(pairs.join(F.broadcast(table), "_factor")
                     .where(F.rlike(searched, F.col("pattern"))).select(*keys, "line_number", "pattern_idx"))
    if rest:
        numbers = F.array(*[F.lit(i) for i in rest])
        plain = secret_hits(files, *keys, patterns=[patterns[i] for i in rest], text=text)
        parts.append(plain.select(*keys, "line_number", F.element_at(numbers, F.col("pattern_idx") + 1).alias("pattern_idx")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def indexed_findings(files: DataFrame, *keys: str, patterns: list[SecretPattern], text: str = "text") -> DataFrame:
    """Secret findings of any text, one per (key, type, line), first pattern first; equal to `secret_findings`.

    Hits are narrow rows; their message texts come from the pattern table after the first of each is chosen.
    """
    patterns = _check(patterns)
    labels = files.sparkSession.createDataFrame([(i, p.type, p.severity) for i, p in enumerate(patterns)],
                                                "pattern_idx int, type string, severity string")
    hits = indexed_hits(files, *keys, patterns=patterns, text=text).join(F.broadcast(labels), "pattern_idx")
    first = first_wins(hits, [*keys, "type", "line_number"], "pattern_idx")
    ordinal = F.lit(stage_base(STAGE_SECRET)) + F.shiftleft("line_number", SUB_BITS) + F.col("pattern_idx")
    message = {**secret_message(patterns[:1]), "type": F.col("type"), "severity": F.col("severity")}
    message["description"] = F.replace(F.lit(fixed.SECRET_DESCRIPTION), F.lit("{type}"), F.col("type"))
    return static_rows(first.withColumn("ordinal", ordinal), message, *keys)
