"""Risky-call rules as predicates over call sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions import labels
from ..schema import STAGE_CALL, SUB_BITS, stage_base
from .static_rows import static_rows


def _on_module(module: str, *names: str) -> str:
    # Names are taken as written; import aliases are not resolved.
    among = ", ".join(f"'{n}'" for n in names)
    return f"func_kind = 'attribute' AND base_name = '{module}' AND func_name IN ({among})"


#: Rule -> condition on a call site.  No two rules share a call.
CONDITIONS = {
    "code_injection": "func_kind = 'name' AND func_name IN ('eval', 'exec')",
    "command_injection": _on_module("os", "system", "popen"),
    "shell_true": _on_module("subprocess", "run", "call", "Popen", "check_output") + " AND array_contains(kw_true, 'shell')",
    "sql_injection": "func_kind = 'attribute' AND func_name = 'execute' AND arg0_kind IN ('fstring', 'mod', 'format_call')",
    "weak_hash": _on_module("hashlib", "md5", "sha1"),
    "pickle_loads": _on_module("pickle", "loads"),
    "yaml_load": _on_module("yaml", "load") + " AND NOT array_contains(kw_names, 'Loader')",
}

#: Called names any rule looks at; other calls need not leave the parser.
WATCHED_NAMES = frozenset({
    "eval", "exec", "system", "popen", "run", "call", "Popen", "check_output",
    "execute", "md5", "sha1", "loads", "load",
})

RULES = tuple(CONDITIONS)
RULE_TYPES = tuple(fixed.CALL_MESSAGES[rule][1] for rule in RULES)


def rule_index(rules=RULES) -> Column:
    """Index of the rule a call site trips, or null; one CASE, so no row is copied."""
    arms = " ".join(f"WHEN {CONDITIONS[rule]} THEN {RULES.index(rule)}" for rule in rules)
    return F.expr(f"CASE {arms} END")


def _per_rule(values) -> Column:
    """The value of the row's rule, from one literal array."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("rule_idx") + 1)


def call_message() -> dict[str, Column]:
    """Label and text columns of a narrow row (rule_idx, func_name, arg0_kind)."""
    severities, types, descriptions, impacts, fixes, confidences = zip(*[fixed.CALL_MESSAGES[rule] for rule in RULES])
    sql_text, sql_confidence = ({kind: pair[i] for kind, pair in fixed.SQL_DESCRIPTIONS.items()} for i in (0, 1))
    how, rule = F.col("arg0_kind"), F.col("rule_idx")
    is_sql, is_command = rule == RULES.index("sql_injection"), rule == RULES.index("command_injection")
    confidence = (F.when(is_sql, labels.choose(how, sql_confidence))
                  .when(is_command & (how == "fstring"), fixed.COMMAND_FSTRING_CONFIDENCE)
                  .otherwise(_per_rule(confidences)))
    return {
        "severity": _per_rule(severities),
        "type": _per_rule(types),
        "description": F.when(is_sql, labels.choose(how, sql_text)).otherwise(
            F.replace(_per_rule(descriptions), F.lit("{name}"), F.coalesce("func_name", F.lit("")))),
        "impact": _per_rule(impacts),
        "fix": _per_rule(fixes),
        "confidence": confidence,
    }


def call_hits(sites: DataFrame, *keys: str, rules=RULES) -> DataFrame:
    """Call sites that trip one of the rules, as narrow rows."""
    return (sites.where("call_seq >= 0").withColumn("rule_idx", rule_index(rules)).where("rule_idx is not null")
            .select(*keys, call_ordinal().alias("ordinal"), "line_number", "rule_idx", "func_name", "arg0_kind"))


def call_ordinal() -> Column:
    return F.lit(stage_base(STAGE_CALL)) + F.shiftleft("call_seq", SUB_BITS) + F.col("rule_idx")


def call_findings(sites: DataFrame, *keys: str, rules=RULES) -> DataFrame:
    """Findings of the chosen rules, before de-duplication."""
    return static_rows(call_hits(sites, *keys, rules=rules), call_message(), *keys)
