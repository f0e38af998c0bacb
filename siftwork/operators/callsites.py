"""Call sites of Python texts.

Parsing Python is the one step with no column expression, so it runs once per
text inside `mapInPandas` and emits narrow rows; every detection rule is then an
ordinary predicate over those rows.
"""

from __future__ import annotations

import ast
import sys
import warnings

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

# Workers need no copy of this package: the few helpers here travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CALL_SCHEMA = (
    "call_seq bigint, line_number bigint, func_kind string, base_name string, func_name string, "
    "arg0_kind string, kw_names array<string>, kw_true array<string>, parse_error string"
)
#: `call_seq` of the one row that reports how a text parsed.
TEXT_ROW = -1
#: `call_seq` of rows that hand through secret hits of a text that parsed.
SECRET_ROW = -2


def _parse(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(text), None
        except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
            return None, f"{type(problem).__name__}: {problem}"


def _calls(tree):
    """Call nodes in the order they open in the source tree."""
    todo = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, ast.Call):
            yield node
        todo.extend(reversed(list(ast.iter_child_nodes(node))))


def _first_argument(call):
    if not call.args:
        return "none"
    match call.args[0]:
        case ast.JoinedStr():
            return "fstring"
        case ast.BinOp(op=ast.Mod()):
            return "mod"
        case ast.Call(func=ast.Attribute(attr="format")):
            return "format_call"
    return "other"


def _describe(call):
    match call.func:
        case ast.Name(id=name):
            kind, base = "name", None
        case ast.Attribute(value=ast.Name(id=base), attr=name):
            kind = "attribute"
        case ast.Attribute(attr=name):
            kind, base = "attribute", None
        case _:
            kind, base, name = "other", None, None
    named = [k for k in call.keywords if k.arg is not None]
    is_true = [k.arg for k in named if isinstance(k.value, ast.Constant) and k.value.value is True]
    return call.lineno, kind, base, name, _first_argument(call), [k.arg for k in named], is_true


def _parse_batches(keys, with_codes, only_names):
    columns = [*keys, "call_seq", "line_number", "func_kind", "base_name", "func_name",
               "arg0_kind", "kw_names", "kw_true", "parse_error"]
    if with_codes:
        columns.append("code")
    tail = (None,) if with_codes else ()
    nothing = (None,) * 7

    def rows_of(key, text, codes):
        tree, problem = _parse(text)
        yield (*key, TEXT_ROW, *nothing, problem, *tail)
        if tree is None:
            return
        for seq, call in enumerate(_calls(tree)):
            described = _describe(call)
            if only_names is None or described[3] in only_names:
                yield (*key, seq, *described, None, *tail)
        for code in codes:
            yield (*key, SECRET_ROW, *nothing, None, int(code))

    def run(batches):
        for batch in batches:
            keyed = zip(*[batch[k] for k in keys])
            codes = batch["codes"] if with_codes else [()] * len(batch)
            out = []
            for key, text, hits in zip(keyed, batch["text"], codes):
                out.extend(rows_of(key, text, hits))
            for start in range(0, len(out), 20_000):
                yield pd.DataFrame(out[start:start + 20_000], columns=columns)
    return run


def _key_schema(files: DataFrame, keys) -> str:
    return ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)


def call_sites(files: DataFrame, *keys: str, text: str = "text",
               only_names: frozenset[str] | None = None) -> DataFrame:
    """Every call of every text, plus one row (`call_seq` = -1) per text with its parse error."""
    source = files.select(*keys, F.col(text).alias("text")).where(F.col("text").isNotNull())
    schema = f"{_key_schema(files, keys)}, {CALL_SCHEMA}"
    return source.mapInPandas(_parse_batches(list(keys), False, only_names), schema)


def call_sites_with_hits(files: DataFrame, *keys: str, codes: str, text: str = "text",
                         only_names: frozenset[str] | None = None) -> DataFrame:
    """Call sites and, for texts that parse, their secret hits as rows of one pass.

    Handing the few hit codes through the parser applies the parse gate without
    a second pass over the texts and without a join.
    """
    source = (files.select(*keys, F.col(text).alias("text"), F.col(codes).alias("codes"))
              .where(F.col("text").isNotNull()))
    schema = f"{_key_schema(files, keys)}, {CALL_SCHEMA}, code bigint"
    return source.mapInPandas(_parse_batches(list(keys), True, only_names), schema)
