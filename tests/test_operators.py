"""Merging, ordering, rollups and joins under hot keys."""

import pytest
from pyspark.sql import Window, functions as F

from helpers import findings, values
from siftwork.operators import merge, ordering, rollups, skew
from siftwork.operators.ordering import worst_first


def test_merge_covers_by_type_key_only(spark):
    static = findings(spark, [("a", 1, "LOW", "SQL Injection", 3, 0.9, "static")])
    model = findings(spark, [
        ("a", 10, "CRITICAL", "sqlinjection", 99, 0.8, "llm"),       # covered although the line differs
        ("a", 11, "HIGH", "Open Redirect", 1, 0.8, "llm"),
        ("a", 12, "HIGH", "Open Redirect", 1, 0.8, "llm"),           # repeats among replies stay
        ("b", 13, "HIGH", "SQL Injection", 3, 0.8, "llm")])          # other file
    merged = merge.merge_findings(static, model, "file_path")
    assert values(merged, "file_path", "ordinal") == [("a", 1), ("a", 11), ("a", 12), ("b", 13)]
    # The threshold comes after merging: the covered CRITICAL does not return.
    assert values(merge.at_least(merged, "HIGH"), "ordinal") == [(11,), (12,), (13,)]


def test_type_key_compares_24_characters(spark):
    static = findings(spark, [("a", 1, "LOW", "Insecure Deserialization Of Things", 3, 0.9, "static")])
    model = findings(spark, [("a", 2, "LOW", "insecure deserialization  of  th", 3, 0.8, "llm")])
    assert merge.uncovered(model, static, "file_path").count() == 0


def test_first_wins_treats_null_lines_as_one_group(spark):
    rows = findings(spark, [("a", 2, "LOW", "T", None, 0.9, "static"), ("a", 1, "HIGH", "T", None, 0.9, "static"),
                            ("a", 3, "LOW", "T", 1, 0.9, "static")])
    assert values(skew.first_wins(rows, ["file_path", "type", "line_number"], "ordinal"), "ordinal") == [(1,), (3,)]


@pytest.fixture(scope="module")
def hot(spark):
    """60,000 findings, a third of them in one file, with ordinals spread widely."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot.py").otherwise(F.concat(F.lit("f"), (F.col("id") % 500).cast("string")))
        .alias("file_path"),
        (F.col("id") * 977).alias("ordinal"),
        F.element_at(F.array(*map(F.lit, ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"])),
                     (F.col("id") % 5 + 1).cast("int")).alias("severity"),
        F.concat(F.lit("type "), (F.col("id") % 7).cast("string")).alias("type"),
        F.lit("d").alias("description"), F.lit("i").alias("impact"), F.lit("f").alias("fix"),
        (F.col("id") % 50).alias("line_number"), ((F.col("id") % 11) / 10).alias("confidence"),
        F.when(F.col("id") % 2 == 0, "static").otherwise("llm").alias("source"))
    return merge.complete_findings(df)


def test_rank_in_file_equals_a_window(hot):
    plain = F.row_number().over(Window.partitionBy("file_path").orderBy(*worst_first()))
    both = ordering.rank_in_file(hot.withColumn("want", plain), "file_path")
    assert both.count() == 60_000
    assert both.where("rank_in_file <> want").count() == 0


def test_ranks_of_a_hot_file_with_its_own_kind_of_ordinals(spark):
    """Ordinals as the engine makes them, one file with most findings, null ordinals and a null path; no task holds the file."""
    n = 200_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("f"), F.col("id") % 7)).when(F.col("id") % 50 == 1, None).otherwise("hot.py").alias("file_path"),
        F.when(F.col("id") % 1000 != 7, F.shiftleft(F.col("id") * 7919 % n, 20)).alias("ordinal"),
        (F.col("id") % 4).cast("int").alias("severity_score"), F.lit(0.5).alias("confidence"))
    ranked = ordering.rank_in_file(rows, "file_path")
    assert ranked.columns == [*rows.columns, "rank_in_file"]
    plain = Window.partitionBy("file_path").orderBy(*worst_first())
    same = ranked.withColumn("want", F.rank().over(plain)).withColumn("ties", F.count("*").over(
        Window.partitionBy("file_path", "severity_score", "confidence", "ordinal")))
    assert same.where("rank_in_file between want and want + ties - 1").count() == n
    assert ranked.groupBy("file_path").agg((F.countDistinct("rank_in_file") == F.count("*")).alias("all"), F.max("rank_in_file").alias("m"),
                                           F.count("*").alias("n")).where("not all or m <> n").count() == 0
    # The plan has no window over the file alone but the one over its ranges.
    windows = [x for x in ranked._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in x]
    assert sum("[file_path" in x.split("], [")[1] and "_range" not in x.split("], [")[1] for x in windows) <= 1


def test_positions_follow_the_order(spark, hot):
    placed = ordering.with_position(ordering.sort_findings(hot, "file_path")).select("file_path", "ordinal", "position")
    want = hot.withColumn("want", F.row_number().over(Window.orderBy("file_path", *worst_first())))
    assert placed.join(want, ["file_path", "ordinal"]).where("position = want").count() == 60_000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_a_plain_join(hot, how):
    left = hot.select("file_path", "ordinal")
    right = hot.select("file_path").distinct().where("file_path in ('hot.py', 'f1', 'f7')").withColumn("n", F.lit(1))
    got = skew.spread_join(left, right, ["file_path"], how, ["ordinal"])
    want = left.join(right, "file_path", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_hot_file_is_spread_over_partitions(spark, hot):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        right = spark.createDataFrame([("hot.py", 1)], "file_path string, n int")
        joined = skew.spread_join(hot.select("file_path", "ordinal"), right, ["file_path"], "inner", ["ordinal"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1.3 * min(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_wins_prunes_before_the_shuffle(hot):
    plan = skew.first_wins(hot, ["file_path", "type", "line_number"], "ordinal")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.index("WindowGroupLimit") < physical.index("Exchange")
    assert physical.count("WindowGroupLimit") == 2


def files(spark, rows):
    return spark.createDataFrame(rows, "file_path string, language string, file_hash string, from_cache boolean, error string")


def test_rollups_are_dense_and_ties_go_to_the_smallest_path(spark):
    every = files(spark, [("b", "Python", "1", False, None), ("a", "Go", "2", True, None), ("c", "unknown", "", False, "gone")])
    found = findings(spark, [("a", 1, "HIGH", "T", 1, 0.9, "llm"), ("b", 1, "MEDIUM", "T", 1, 0.9, "llm"),
                             ("b", 2, "LOW", "T", 1, 0.9, "llm")])
    rolled = rollups.file_rollup(every, found)
    assert values(rolled, "file_path", "critical", "high", "medium", "low", "info", "risk_score", "worst_severity") == [
        ("a", 0, 1, 0, 0, 0, 3, "HIGH"), ("b", 0, 0, 1, 1, 0, 3, "MEDIUM"), ("c", 0, 0, 0, 0, 0, 0, None)]
    run = rollups.run_rollup(rolled, "CRITICAL").first()
    assert (run["files_scanned"], run["total_vulnerabilities"], run["cache_hits"]) == (3, 3, 1)
    assert run["riskiest_file"] == "a" and run["breached"] is False
    assert rollups.run_rollup(rolled, "HIGH").first()["breached"] is True
    assert values(rollups.file_status(rolled), "file_path", "status", "detail") == [
        ("a", "findings", "HIGH · cached"), ("b", "findings", "MEDIUM · 2 finding(s)"), ("c", "error", "gone")]


def test_riskiest_file_exists_without_findings_but_not_without_files(spark):
    none = findings(spark, [("x", 1, "LOW", "T", 1, 0.9, "llm")]).limit(0)
    clean = rollups.file_rollup(files(spark, [("b", "Go", "1", False, None), ("a", "Go", "2", False, None)]), none)
    assert rollups.run_rollup(clean).first()["riskiest_file"] == "a"
    empty = rollups.run_rollup(clean.limit(0)).first()
    assert empty["riskiest_file"] is None and empty["files_scanned"] == 0 and empty["breached"] is False
    assert rollups.gate(none, "INFO").first()["breached"] is False


def test_gate_sees_filtered_findings_only(spark):
    found = findings(spark, [("a", 1, "HIGH", "T", 1, 0.9, "llm")])
    assert rollups.gate(found, "HIGH").first()["breached"] is True
    assert rollups.gate(merge.at_least(found, "CRITICAL"), "HIGH").first()["breached"] is False


def test_result_cards(spark):
    rows = spark.createDataFrame([("a", "clean", None), ("b", "done", "CRITICAL"), ("c", "skip", None), ("d", "done", "LOW")],
                                 "file_path string, status string, severity string")
    assert [r["file_path"] for r in rollups.result_cards(rows).collect()] == ["b", "d", "a"]
