"""Text expressions.  All are built-in column expressions; none calls Python per row."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, functions as F

from .. import fixed

#: Code points that count as white space when trimming (Python's definition,
#: which is wider than SQL trim).
WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

#: Line ends recognised when numbering lines.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
_LINE_END_BUT_LF = "[\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
_LINE_ENDS = "\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029"

_DECIMALS = [chr(c) for c in range(128, sys.maxunicode + 1)
             if unicodedata.category(chr(c)) == "Nd"]
_DECIMALS_ASCII = "".join(str(unicodedata.decimal(c)) for c in _DECIMALS)


def strip_ws(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def normalise_newlines(col: Column) -> Column:
    """CRLF and lone CR become LF; texts without CR are passed through untouched."""
    return F.when(F.contains(col, F.lit("\r")), F.regexp_replace(col, "\r\n?", "\n")).otherwise(col)


def decode_utf8(col: Column) -> Column:
    """Bytes to text: bad sequences are replaced, newlines normalised."""
    return normalise_newlines(F.make_valid_utf8(col.cast("string")))


def split_lines(col: Column) -> Column:
    """All lines of a text; a final line end opens no further line.

    Texts that use LF only, nearly all, take the plain split.
    """
    body = (F.when(col.endswith("\r\n"), F.substring(col, F.lit(1), F.length(col) - 2))
            .when(F.substring(col, -1, 1).isin(*_LINE_ENDS), F.substring(col, F.lit(1), F.length(col) - 1))
            .otherwise(col))
    lines = F.when(col.rlike(_LINE_END_BUT_LF), F.split(body, LINE_END, -1)).otherwise(F.split(body, "\n", -1))
    return F.when(col == "", F.array().cast("array<string>")).otherwise(lines)


def extract_field(block: Column, name: str) -> Column:
    """Value of `NAME: value` in a reply block: the first line after the colon.

    White space after the colon may cross a line end, so an empty field takes
    the next line.  Only LF ends a line here.
    """
    pattern = rf"(?mdU)^{name}:[\s\x1C-\x1F]*([^\n]+)"
    return strip_ws(F.regexp_extract(block, pattern, 1))


def split_blocks(col: Column) -> Column:
    """Reply text cut at separator lines of three or more dashes."""
    padded = F.concat(F.lit("\n"), strip_ws(col), F.lit("\n"))
    return F.split(padded, "\n-{3,}\n", -1)


def parse_severity(raw: Column) -> Column:
    value = F.upper(strip_ws(raw))
    return F.when(value.isin(*fixed.SEVERITY_SCORES), value).otherwise("MEDIUM")


def parse_line(raw: Column) -> Column:
    """Digits of a line field as one number; none, zero or overflow give null."""
    text = strip_ws(raw)
    plain = F.translate(text, "".join(_DECIMALS), _DECIMALS_ASCII)
    digits = F.regexp_replace(plain, "[^0-9]", "")
    number = F.nullif(digits.try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(F.upper(text).isin(*fixed.REPLY_NO_LINE), F.lit(None).cast("bigint")).otherwise(number)


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_prefix(file_hash: Column) -> Column:
    return F.concat(F.substring(file_hash, 1, 12), F.lit("…"))


def is_blank(text: Column) -> Column:
    return strip_ws(text) == ""


_PR_LINK = r"^https?://github\.com/([^/]+)/([^/]+)/pull/([0-9]+)"


def parse_pr_link(url: Column) -> Column:
    """Struct of owner, repo and number; null when the text is no pull-request link."""
    text = strip_ws(url)
    return F.when(text.rlike(_PR_LINK), F.struct(
        F.regexp_extract(text, _PR_LINK, 1).alias("owner"),
        F.regexp_extract(text, _PR_LINK, 2).alias("repo"),
        F.regexp_extract(text, _PR_LINK, 3).try_cast("bigint").alias("number"),
    ))


def progress_pct(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(F.lit(100.0) * done / total)).otherwise(0).cast("bigint")
