"""Quality rules whose cutoffs are certified on labelled documents.

Every rule looks at one ratio of a text in percent (symbols per word, share of repeated
words, ...).  A document's level is the largest of its ratios, and a stratum's cutoff
rejects documents whose level reaches it.  Cutoffs are tried on a fixed grid, from lenient
to strict: for each one an exact binomial test on labelled good documents asks
whether false rejections are limited to the allowed rate.  Testing stops at the first
cutoff that fails (fixed-sequence testing, no correction needed along the grid).  The
chance of error is divided among the strata by their number of labelled good documents
(weighted Bonferroni); strata in which not even a cutoff without any loss could be
proved are not tested and take no part of it.  The grid and the rules are set before any label is
seen, so with probability of at least 1 - delta no stratum loses more than `alpha` of
its good documents.  A stratum without a certified cutoff has only the base rule.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftwork.operators.membership import that_may_match
from siftwork.session import materialise

from .common import BLANKS, column, keyed

#: The allowed rate of rejected good documents per stratum and the chance that it is exceeded.
ALPHA, DELTA = 0.02, 0.05
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]
SYMBOLS, MARKS, CAPITALS = "#*$%&|<>", "!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rule name: (numerator, denominator).  The grid of cutoffs is k / GRID for
#: k = 1 .. GRID; larger ratios count as GRID.
RULES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "capitals_per_char": ("n_capitals", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
}
GRID = 100
#: Among certified cutoffs, the bad documents caught less so many times the good ones lost decide.
LOSS_WEIGHT = 10


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def measured(rows: DataFrame) -> DataFrame:
    """`rows` (with _text) and the MEASURES of each text, all long; a null text has no words.

    Repeated three-word windows are found inside each row, by sorting the hashes
    of its windows: no shuffle, linear memory and n log n time in the words of
    one text.  Window hashes have 64 bits and are compared only within a text.
    """
    text = F.coalesce("_text", F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t\n\x0b\f\r]+"))
    rows = rows.withColumn("_words", words).withColumn("n_words", F.size("_words").cast("long"))
    hashes = F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
    rows = rows.withColumn("_hashes", hashes).drop("_words")
    # Most texts repeat no window; only the others are sorted.
    windows = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.array_sort(
        F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    rows = rows.withColumn("_windows", windows).drop("_hashes")
    # A window counts if a neighbour in the sorted order has the same hash.
    repeated = F.filter("_windows", lambda x, i: (
        (F.get("_windows", i - 1)["h"] == x["h"]) | F.coalesce(F.get("_windows", i + 1)["h"] == x["h"], F.lit(False))))
    rows = rows.withColumn("_at", F.array_sort(F.transform(repeated, lambda x: x["p"]))).drop("_windows")
    # Words covered: each window adds up to three, less where the next one begins.
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, x: total + x)
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    rows = rows.withColumn("_lines", lines)
    # A later filter on the measures must not be pushed below them, where each use
    # would compute them again; Spark moves no filter past a row number.
    return rows.select(
        *[c for c in rows.columns if c not in ("_at", "_lines", "n_words")], "n_words", F.monotonically_increasing_id().alias("_once"),
        F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _count(text, CAPITALS).cast("long").alias("n_capitals"), _count(text, MARKS).cast("long").alias("n_marks"),
    ).where("_once >= 0").drop("_once")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _level() -> Column:
    """The number of grid cutoffs that a row reaches under any rule, in whole numbers."""
    return F.greatest(*[
        F.when(F.col(under) > 0, F.least(F.lit(GRID), F.expr(f"{GRID} * {over} div {under}"))).otherwise(0).cast("int")
        for over, under in RULES.values()])


def _stratum(name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit("null"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), exactly, by the terms' ratios; 1 where k is above the mean."""
    ratio = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def step(acc, i):
        term = acc["t"] + F.log((n - i + 1) / i) + ratio
        return F.struct(term.alias("t"), (acc["s"] + F.exp(term)).alias("s"))

    steps = F.when((k >= 1) & (k <= n * p), F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(steps, start, step)["s"])


def _known(labels: DataFrame) -> DataFrame:
    """(_id, _good) of the usable labels; a document labelled both ways counts as good."""
    return (labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("_id"))
            .agg(F.max("quality").alias("_good")))


def fit_cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(_stratum, _cutoff) from features (_id, _stratum, MEASURES) and labels (doc_id, quality).

    Labels: quality 1 is good, 0 bad, anything else is ignored; a document
    labelled both ways counts as good; repeated equal rows count once.  Only
    documents that the base rule keeps are counted.  Counting is by (stratum,
    level) with partial aggregation, so a stratum with a third of all
    rows is some hundred rows after the map side.
    """
    held = features.where(~base_failed()).join(_known(labels), "_id").distinct()
    counts = (held.groupBy("_stratum", _level().alias("level"))
              .agg(F.sum("_good").cast("long").alias("good"), F.sum(1 - F.col("_good")).cast("long").alias("bad")))
    # Per stratum at most GRID + 1 levels: small arrays.
    tables = materialise(counts.groupBy("_stratum").agg(
        F.sum("good").alias("n"), F.collect_list(F.struct("level", "good", "bad")).alias("levels"))
        .where(F.pow(F.lit(1 - alpha), F.col("n")) <= F.lit(delta)), "quality-levels")
    tested = tables.agg(F.sum("n").alias("n")).first()["n"] or 1
    at = lambda field: F.aggregate(
        F.filter("levels", lambda x: x["level"] >= F.col("cut")), F.lit(0).cast("long"), lambda total, x: total + x[field])
    cuts = (tables.select("*", F.explode(F.sequence(F.lit(1), F.lit(GRID))).alias("cut"))
            .select("_stratum", "n", "cut", at("good").alias("lost"), at("bad").alias("caught"))
            .withColumn("sure", binomial_tail(F.col("n"), F.col("lost"), alpha) <= F.lit(delta) * F.col("n") / F.lit(tested))
            .withColumn("gain", F.col("caught") - LOSS_WEIGHT * F.col("lost")))
    # From the lenient end: a cutoff stands if it and all more lenient ones pass.
    best = (cuts.groupBy("_stratum").agg(
        F.max(F.when(~F.col("sure"), F.col("cut"))).alias("fails"),
        F.collect_list(F.struct("gain", "cut")).alias("all"))
        .withColumn("best", F.array_max(F.filter("all", lambda x: (x["cut"] > F.coalesce("fails", F.lit(0))) & (x["gain"] > 0)))))
    return best.where("best is not null").select("_stratum", F.col("best.cut").alias("_cutoff"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(_id, _stratum, MEASURES) per document."""
    rows = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text"), _stratum(column(stratum_col)).alias("_stratum"))
    return measured(rows).select("_id", "_stratum", *MEASURES)


def judged(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Rows with _stratum and MEASURES, and the columns base_failed and kept.

    `cutoffs` has one small row per stratum; Spark broadcasts it if its measured
    size allows and otherwise joins it by stratum with skew splitting.
    """
    rejected = F.coalesce(_level() >= F.col("_cutoff"), F.lit(False))
    return (rows.join(cutoffs, "_stratum", "left").withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_cutoff"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(id, MEASURES, base_failed, kept) per document.

    A null text has no words and fails the base rule; a null stratum is a
    stratum of its own; repeated rows get equal verdicts; without labels only the
    base rule decides; an empty table gives none.  Texts of any length are measured whole, in
    memory linear in one text.  An id column named like a measure or
    verdict takes its place.  The measures are narrow and written once, for the fit and the verdicts.
    """
    rows = materialise(features(docs, id_col, text_col, stratum_col), "quality-measures")
    cutoffs = materialise(fit_cutoffs(rows, labels, alpha, delta), "quality-cutoffs")
    results = [c for c in (*MEASURES, "base_failed", "kept") if c.lower() != id_col.lower()]
    return judged(rows, cutoffs).select(F.col("_id").alias(id_col), *results)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of `docs` that the rules keep, columns unchanged.

    For the fit only documents that may have a label are measured, chosen by a filter of
    bounded size; no text is shuffled.  Nulls, repeated rows and missing labels count as in
    `quality_verdicts`; columns of any name and texts of any length are carried.
    """
    known = materialise(labels.where("quality in (0, 1) and doc_id is not null").select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "quality"), "quality-labels")
    asked = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("_text"), column(stratum_col).alias("_name"))
    asked = that_may_match(asked, known.select("doc_id"), "doc_id")
    cutoffs = materialise(fit_cutoffs(features(asked, "doc_id", "_text", "_name"), known, alpha, delta), "quality-cutoffs")
    rows = measured(keyed(docs, id_col, text_col).withColumn("_stratum", _stratum(column(stratum_col) if stratum_col == text_col
                                                                                  else F.col("_row")[stratum_col])))
    return judged(rows, cutoffs).where("kept").select(
        *[(F.col("_text") if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
