"""The scan: texts -> findings -> merged findings -> per-file and per-run results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import detect_language
from ..operators.callsites import SECRET_ROW, call_sites_with_hits
from ..operators.membership import that_may_match
from ..operators.merge import at_least, merge_findings
from ..operators.replies import parse_replies, reply_findings
from ..operators.rollups import dense, distinct_contents, finding_rollup, run_rollup
from ..operators.rules import RULE_TYPES, WATCHED_NAMES, call_message, call_ordinal, rule_index
from ..operators.secrets import BUILTIN_PATTERNS, describe_codes, hit_codes, line_of, pattern_of, secret_findings, secret_message
from ..operators.skew import first_wins, spread_join
from ..operators.static_rows import static_rows
from ..schema import FINDING_COLUMNS, STAGE_SECRET, SUB_BITS, finding_rows, stage_base
from ..session import materialise
from ..sources.cache import REPLY_PASS, STATIC_PASS, CacheTables, FindingCache, cache_lookup
from ..sources.inputs import one_reply_each, with_identity


def static_sites(texts: DataFrame, *keys: str, patterns=BUILTIN_PATTERNS) -> DataFrame:
    """Call sites and gated secret hits of Python texts, from one pass over them.

    Line regexes run in the JVM first and only their few hit codes travel
    through the parser with the text.
    """
    coded = texts.select(*keys, "text", hit_codes(F.col("text"), patterns).alias("codes"))
    return call_sites_with_hits(coded, *keys, codes="codes", only_names=WATCHED_NAMES)


def findings_of_sites(sites: DataFrame, *keys: str, patterns=BUILTIN_PATTERNS) -> DataFrame:
    """Findings of parsed rows, one per (key, type, line), first in source order.

    Calls and secrets stay in one stream of narrow rows, so the parser runs once
    and only hits, without their message text, are shuffled to be de-duplicated.
    """
    is_secret = F.col("call_seq") == SECRET_ROW
    types = F.array(*[F.lit(t) for t in (*RULE_TYPES, *(p.type for p in patterns))])
    narrow = (sites.where(is_secret | (F.col("call_seq") >= 0))
              .withColumn("rule_idx", F.when(~is_secret, rule_index()))
              .withColumn("pattern_idx", F.when(is_secret, pattern_of(F.col("code"))))
              .where("rule_idx is not null or pattern_idx is not null")
              .select(*keys,
                      F.when(is_secret, F.lit(stage_base(STAGE_SECRET)) + F.col("code"))
                      .otherwise(call_ordinal()).alias("ordinal"),
                      F.coalesce(line_of(F.col("code")), "line_number").alias("line_number"),
                      F.element_at(types, 1 + F.coalesce("rule_idx", F.lit(len(RULE_TYPES)) + F.col("pattern_idx")))
                      .alias("_type"),
                      "rule_idx", "pattern_idx", "func_name", "arg0_kind"))
    first = first_wins(narrow, [*keys, "_type", "line_number"], "ordinal")
    of_call, of_secret = call_message(), secret_message(patterns)
    message = {name: F.when(F.col("rule_idx").isNotNull(), of_call[name]).otherwise(of_secret[name])
               for name in of_call}
    return static_rows(first, message, *keys)


def static_findings(texts: DataFrame, *keys: str, gate: str = "python", patterns=BUILTIN_PATTERNS) -> DataFrame:
    """The whole static pass over texts.

    `gate="python"`: risky calls and secrets of texts that parse as Python.
    `gate="none"`: secrets of any text.
    """
    if gate == "none":
        return secret_findings(texts, *keys, patterns=patterns)
    return findings_of_sites(static_sites(texts, *keys, patterns=patterns), *keys, patterns=patterns)


@dataclass
class ScanResult:
    """`files`: one row per path; `findings`: per path, with the path's language; `by_hash`: the same
    once per content; `fresh_*`: what was analysed now, ready for the cache; `failed`: contents whose
    reply failed, with its error."""

    files: DataFrame
    by_hash: DataFrame
    manifest: DataFrame
    fresh_entries: DataFrame
    fresh_findings: DataFrame
    failed: DataFrame | None = None

    @property
    def findings(self) -> DataFrame:
        return fan_back(self.manifest, self.by_hash)

    @property
    def failed_replies(self) -> DataFrame | None:
        """(file_path, error) of every path whose reply failed or is empty; None for a scan without replies."""
        if self.failed is None:
            return None
        paths = self.manifest.where("file_hash <> ''").select("file_path", "file_hash")
        return spread_join(paths, self.failed, ["file_hash"], "inner", ["file_path"]).select("file_path", "error")

    def run(self, fail_on: str = "HIGH") -> DataFrame:
        return run_rollup(self.files, fail_on)


def fan_back(manifest: DataFrame, by_hash: DataFrame) -> DataFrame:
    """Findings of a content for every path that holds it.

    The copies are the side that can be hot, so they are spread; the findings of
    one content are bounded by its text.
    """
    paths = manifest.where("file_hash <> ''").select("file_path", "file_hash", "language")
    return spread_join(paths, finding_rows(by_hash, "file_hash"), ["file_hash"], "inner", ["file_path"]).select(
        "file_path", "file_hash", "language", *FINDING_COLUMNS)


def unknown_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts (file_hash, file_path, text) that are worth parsing: one per content of `wanted` (file_hash, file_path), and few others.

    Copies and contents that are not wanted stay out before the parser; texts are not shuffled.
    """
    return that_may_match(texts, wanted, "file_hash", "file_path").select("file_hash", "text")


def _piece_manifest(pieces: DataFrame, codes: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The manifest of files read in pieces, and their hits (file_path, code) with lines counted from the file's first."""
    failed = F.coalesce("error", F.lit("")) != ""
    shifted = [F.transform(c, lambda x: x + F.shiftleft(F.col("first_line") - 1, SUB_BITS)).alias("codes") for c in codes]
    rows = materialise(pieces.select(
        "file_path", "last", F.when(failed, "").otherwise(F.col("file_hash")).alias("file_hash"),
        F.when(failed, "unknown").otherwise(detect_language(F.col("file_path"))).alias("language"), "error", *shifted), "manifest")
    manifest = rows.where("last").select("file_path", "file_hash", "language", "error")
    hits = rows.select("file_path", F.explode("codes").alias("code")) if codes else None
    return manifest, hits


def scan(files: DataFrame, replies: DataFrame | None = None, cache: CacheTables | FindingCache | None = None, *,
         use_static: bool = True, min_severity: str = "LOW", gate: str = "python",
         patterns=BUILTIN_PATTERNS, report_failed_replies: bool = True) -> ScanResult:
    """Scan `files` (file_path, text, optional error).

    A content is known by its hash, never by a path, which many texts may share.
    Its findings count under the language of its smallest path, and only if the
    cache does not know it.  Texts are never shuffled: calls and line hits leave
    the reading pass as narrow rows with the hash of the very text they were found
    in, and are joined by it.  With the parse gate texts are read twice, once to hash
    and once to parse; a filter of bounded size keeps copies and contents that the cache
    knows away from the parser, and findings carry the hash of the text parsed.

    `files` may also come in pieces (`read_pieces`): a file of any size then counts with
    all its lines.  A file of several pieces cannot be parsed and gives nothing behind the parse gate.

    The cache remembers which passes an entry stands for (`passes`); an entry that
    lacks a pass of this run is a miss.  Of several `replies` for one hash the first
    usable one counts.
    """
    if gate not in ("python", "none"):
        raise ValueError(f"unknown gate {gate!r}")
    if "error" not in files.columns:
        files = files.withColumn("error", F.lit(None).cast("string"))
    in_one_pass = use_static and gate == "none"
    codes = [hit_codes(F.col("text"), patterns).alias("codes")] if in_one_pass else []
    if "piece" in files.columns:
        manifest, piece_hits = _piece_manifest(files, codes)
        if in_one_pass:
            hit = piece_hits.join(manifest.where("file_hash <> ''").select("file_path", "file_hash"), "file_path")
        files = files.where("piece = 0 and last").drop("file_hash")  # what can be parsed as a whole
    else:
        hashed = materialise(
            with_identity(files).select("file_path", "file_hash", "language", "error", *codes), "manifest")
        manifest = hashed.drop("codes")
        if in_one_pass:
            hit = hashed.where("size(codes) > 0").select("file_hash", F.explode("codes").alias("code"))

    contents = distinct_contents(manifest.where("file_hash <> ''")).withColumn(
        "language", detect_language(F.col("file_path")))
    if cache is None:
        contents = materialise(contents.withColumn("from_cache", F.lit(False)), "contents")
    else:
        distinct = materialise(contents, "distinct")
        if isinstance(cache, FindingCache):
            cache = cache.read(only=distinct)
        needed = [STATIC_PASS] * use_static + [REPLY_PASS] * (replies is not None)
        contents = materialise(cache_lookup(distinct, cache.entries, needed), "contents")
    misses = contents.where("not from_cache").select("file_hash", "file_path", "language")

    fresh = None
    if in_one_pass:
        fresh = describe_codes(hit.select("file_hash", "code").distinct().join(misses.select("file_hash"), "file_hash", "left_semi"),
                               "file_hash", patterns=patterns)
    elif use_static:
        wanted = misses.where("language = 'Python'").select("file_hash", "file_path")
        python_files = with_identity(files.where(detect_language(F.col("file_path")) == "Python")).where("file_hash <> ''")
        texts = unknown_texts(python_files.select("file_hash", "file_path", "text"), wanted)
        sites = static_sites(texts, "file_hash", patterns=patterns)
        fresh = findings_of_sites(sites.join(wanted.select("file_hash"), "file_hash", "left_semi"), "file_hash", patterns=patterns)
    failed_replies = None
    if replies is not None:
        wanted_replies = one_reply_each(replies.join(misses.select("file_hash"), "file_hash", "left_semi"))
        failed_replies = wanted_replies.where("error is not null or response_text is null").select("file_hash", "error")
        answered = wanted_replies.where("error is null and response_text is not null").select(
            "file_hash", F.lit(True).alias("_answered"))
        found = (reply_findings if report_failed_replies else parse_replies)(wanted_replies, "file_hash")
        if fresh is not None:
            # Both passes run in one job and are written before the merge reads them repeatedly.
            both = materialise(fresh.unionByName(found), "analysed")
            found = merge_findings(both.where("source = 'static'"), both.where("source <> 'static'"), "file_hash")
        fresh = found
    if fresh is None:
        fresh = describe_codes(misses.limit(0).select("file_hash", F.lit(0).cast("bigint").alias("code")), "file_hash")
    fresh = materialise(finding_rows(fresh, "file_hash"), "fresh")

    passes = F.lit(STATIC_PASS if use_static else "")
    entries = misses.withColumn("scanned_at", F.current_timestamp())
    if replies is None:
        entries = entries.withColumn("passes", passes)
    else:
        # Without a reply only the static pass is remembered.
        entries = entries.join(answered, "file_hash", "left").withColumn(
            "passes", F.concat_ws("+", F.nullif(passes, F.lit("")), F.when(F.col("_answered"), F.lit(REPLY_PASS)))).drop("_answered")
    entries = entries.where("passes <> ''")
    storable = fresh
    if failed_replies is not None:
        # A failed reply is reported but not remembered, so the next run tries again.
        entries = entries.join(failed_replies.select("file_hash"), "file_hash", "left_anti")
        storable = fresh.join(failed_replies.select("file_hash"), "file_hash", "left_anti")

    by_hash = fresh
    if cache:
        hits = contents.where("from_cache").select("file_hash")
        by_hash = fresh.unionByName(
            finding_rows(cache.findings.join(hits, "file_hash", "left_semi"), "file_hash"))
    by_hash = at_least(by_hash, min_severity)

    # Everything known per content first, so that copies are joined only once.
    per_content = contents.select("file_hash", "from_cache").join(
        finding_rollup(by_hash, "file_hash"), "file_hash", "left")
    rolled = dense(spread_join(manifest, per_content, ["file_hash"], "left", ["file_path"]).withColumn(
        "from_cache", F.coalesce("from_cache", F.lit(False))))
    return ScanResult(
        files=rolled, by_hash=by_hash, manifest=manifest,
        fresh_entries=entries, fresh_findings=storable, failed=failed_replies)
