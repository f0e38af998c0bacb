"""Registered queries and their oracle statements, side by side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwork import fixed
from siftwork.functions.text import WHITESPACE
from siftwork.session import tune

from .views import duck_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; `oracle` is a DuckDB statement over the views."""
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = f"{duck_views()}\n{with_ctes(oracle)}"
        return fn
    return add


def with_ctes(statement: str) -> str:
    """A statement that opens with its own WITH continues the view list."""
    body = statement.strip()
    return "," + body[4:] if re.match(r"WITH\s", body) else body


# --- SQL snippets of the oracle side ----------------------------------------

def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_case(column: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {sql_text(k) if isinstance(k, str) else k} THEN "
                    f"{sql_text(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


WS = sql_text(WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def suffix(path: str) -> str:
    return rf"lower(regexp_extract({path}, '[^/](\.[^./]+)$', 1))"


def language(path: str) -> str:
    return sql_case(suffix(path), fixed.SUFFIX_LANGUAGES, "'Unknown'")


def scannable(path: str) -> str:
    return f"{suffix(path)} IN ({', '.join(map(sql_text, fixed.SUFFIX_LANGUAGES))})"


def score(severity: str) -> str:
    return sql_case(severity, fixed.SEVERITY_SCORES)


def severity_of(value: str) -> str:
    return sql_case(value, {v: k for k, v in fixed.SEVERITY_SCORES.items()})


def owasp(kind: str) -> str:
    arms = " ".join(f"WHEN contains(lower({kind}), {sql_text(w)}) THEN {sql_text(c)}"
                    for w, c in fixed.OWASP_KEYWORDS)
    return f"CASE {arms} END"


def type_key(kind: str) -> str:
    return f"left(replace(lower({kind}), ' ', ''), 24)"


def rule_id(kind: str) -> str:
    return f"'SS-' || left(replace(replace(replace(upper({kind}), ' ', '-'), '(', ''), ')', ''), 40)"


def field(block: str, name: str) -> str:
    return strip(rf"regexp_extract({block}, '(?m)^{name}:\s*([^\n]+)', 1)")


def parsed_severity(raw: str) -> str:
    names = ", ".join(map(sql_text, fixed.SEVERITY_SCORES))
    return f"CASE WHEN upper({strip(raw)}) IN ({names}) THEN upper({strip(raw)}) ELSE 'MEDIUM' END"


def parsed_line(raw: str) -> str:
    none = ", ".join(map(sql_text, fixed.REPLY_NO_LINE))
    return (f"CASE WHEN upper({strip(raw)}) IN ({none}) THEN NULL "
            f"ELSE nullif(try_cast(regexp_replace({raw}, '[^0-9]', '', 'g') AS BIGINT), 0) END")


COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE severity = '{s}') AS BIGINT) AS {s.lower()}"
                   for s in fixed.SEVERITY_SCORES)

#: The findings view with score and category.
TYPED = f"typed AS (SELECT *, {score('severity')} AS severity_score, {owasp('type')} AS owasp FROM findings)"
