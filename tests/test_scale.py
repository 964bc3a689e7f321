"""Plans and partitions that keep a query's cost in proportion to its input."""

from pathlib import Path
from random import Random

from pyspark.sql import functions as F

from revlake.functions import lexing, unified
from revlake.functions.text import let
from revlake.languages import GO, JAVASCRIPT, RUST
from revlake.operators import joins
from revlake.operators import security as S
from revlake.plans.incremental import QUERIES
from revlake.sources import readers
from revlake.sources.staging import shared_folder, stage

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_row_group_is_dealt_to_tasks_that_grow_with_its_rows(spark, tmp_path):
    rows, cores = 10 * readers.SPREAD_ROWS, spark.sparkContext.defaultParallelism
    path = str(tmp_path / "t")
    wide = spark.range(rows, numPartitions=1).withColumn("more", F.sha2(F.col("id").cast("string"), 512))
    wide.write.option("parquet.block.size", 1 << 30).parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        stored = spark.read.parquet(path)
        assert stored.rdd.getNumPartitions() * 4 > cores
        shares = readers.spread(stored.select("id")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(shares) >= 10 and max(r["count"] for r in shares) <= 2 * readers.SPREAD_ROWS


def test_runs_with_derived_replies_take_diffs_apart_once(spark):
    for name in ("deliveries_to_reviews", "repeated_push", "rollback_failed"):
        plan = plan_of(QUERIES[name].build(spark, SF_DIR))
        assert "diff_text" not in plan and "diff --git" not in plan, name


def test_rules_share_no_anchor_however_many_there_are(spark):
    key = F.col("id").cast("string")
    rules = spark.range(3000).select(key.alias("rule_id"), F.concat(F.lit("f"), key, F.lit("(")).alias("needle"))
    shared = S.rule_index(rules).groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert shared <= 3


def test_equal_texts_match_a_rule_once_each(spark):
    fields = "rule_id string, language string, needle string, pattern string, severity string, confidence string, description string"
    index = S.rule_index(spark.createDataFrame([("a", None, "evaluate(", r"evaluate\(", "LOW", "LOW", "d"), ("b", "go", "eva", "eva", "LOW", "LOW", "d")], fields))
    texts = spark.createDataFrame([(1, "x\nevaluate(y)", "go")] * 2 + [(2, "evaluate(", "rust"), (3, None, "go"), (4, "ev", "go")], "k long, t string, lang string")
    found = S.scan_with_rule_table(texts, "k", "t", "lang", index)
    rows = sorted((r.k, r.test_id, r.line_number) for r in found.collect())
    assert rows == [(1, "a", 2), (1, "a", 2), (1, "b", 2), (1, "b", 2), (2, "a", 1)]


def test_runs_of_texts_are_filtered_where_they_stand_however_many_rules_there_are(spark, monkeypatch):
    # As if there were more rules than once were sent to every task.
    monkeypatch.setattr(S, "SENT_ANCHORS", 0, raising=False)
    key = F.col("id").cast("string")
    named = F.concat(F.lit("f"), key, F.lit("("))
    index = spark.range(2000).select(
        key.alias("rule_id"), F.lit(None).cast("string").alias("language"), named.alias("needle"), F.concat(F.lit(r"\bf"), key, F.lit(r"\(")).alias("pattern"),
        *(F.lit("x").alias(c) for c in ("severity", "confidence", "description")),
    )
    index = stage(S.rule_index(index), "rules")
    texts = spark.range(1000).select("id", F.concat(F.repeat(F.lit("other words, "), 20), named).alias("t"), F.lit("go").alias("lang"))
    monkeypatch.setattr(S, "MOST_BLOCKS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = S.scan_with_rule_table(texts, "id", "t", "lang", index)
        joins_ = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
        rows = found.select("id", "test_id", "line_number").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("BroadcastHashJoin" in line for line in joins_) == 1, joins_
    assert sorted(tuple(r) for r in rows) == [(i, str(i), 1) for i in range(1000)]


def test_the_filter_of_anchors_loses_none_and_lets_few_others_pass(spark):
    anchors = spark.range(3000).select(F.xxhash64("id").alias("_anchor"))
    grams = spark.range(100_000).select("id", F.xxhash64("id").alias("_anchor"))
    passed = {r.id for r in S._known_anchors(grams, anchors).collect()}
    assert passed >= set(range(3000)) and len(passed) < 3000 + 97_000 // 100
    assert S._known_anchors(grams, anchors.limit(0)).count() == 0


def test_batches_of_a_stream_are_not_written_by_one_task(spark):
    before = set(Path(shared_folder(spark).removeprefix("file:")).glob("stream-runs-*"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        QUERIES["stream_runs_finished"].build(spark, SF_DIR).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    (folder,) = set(Path(shared_folder(spark).removeprefix("file:")).glob("stream-runs-*")) - before
    assert len(list(folder.glob("flagged/part-*"))) > 1


def test_a_value_used_several_times_is_neither_listed_nor_copied(spark):
    rows = spark.createDataFrame([("ab",), (None,)], "t string")
    found = rows.select(let(F.upper("t"), lambda v: F.concat(v, F.coalesce(v, F.lit("none")), v)).alias("x"), let(F.split("t", ""), F.size).alias("n"))
    assert [tuple(r) for r in found.collect()] == [("ABABAB", 2), (None, None)]
    plan = plan_of(found)
    assert "transform(" not in plan and plan.count("upper(") == 1


def test_an_end_that_the_passes_told_is_not_searched_again(spark):
    text = "function a() {\n  b();\n}\n// rest\n"
    told = spark.createDataFrame([(text, [(0, True, 14, end)]) for end in (None, -1, 0, 20)], "t string, e array<struct<offset:int,is_function:boolean,first:int,end:int>>")
    chunks = lexing.signature_chunks(JAVASCRIPT, F.col("t"))
    found = lexing.functions_in(JAVASCRIPT, F.col("t"), chunks=chunks, ends=F.col("e"))
    rows = told.select(F.transform(found, lambda f: F.length(f["source"]))).collect()
    # Unknown, dropped, open, and one that only the passes could tell.
    assert [r[0] for r in rows] == [[23], [], [len(text)], [20]]


def test_a_lookup_of_many_rows_is_not_broadcast_whatever_its_estimate(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "keys")
    spark.range(40_000).write.parquet(path)
    wide = F.concat(F.lit("k"), F.col("id").cast("string"))
    lookup = spark.read.parquet(path).select(wide.alias("key"), F.array_repeat(wide, 50).alias("more"))
    facts = spark.range(1000).select("id", F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("key"))
    plain = joins.lookup_join(facts, lookup, "key", F.col("id"))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10_000)
    monkeypatch.setattr(joins, "REPEATED_ROWS", 480_000)
    monkeypatch.setattr(joins, "TASK_ROWS", 1_000)
    salted = joins.lookup_join(facts, lookup, "key", F.col("id"))
    assert joins.estimated_bytes(lookup) <= joins.broadcast_limit(lookup)
    plan = plan_of(salted)
    assert "12) as int) AS _salt" in plan and ", 480\n" in plan
    assert salted.exceptAll(plain.select(salted.columns)).count() == 0 and salted.count() == 1000


def test_a_hunk_header_is_read_once_and_not_for_every_line(spark):
    chunk = F.col("t")
    for expression, most in ((unified.added_lines(chunk), 3), (unified.hunk_is_consistent(chunk), 6)):
        plan = plan_of(spark.createDataFrame([("",)], "t string").select(expression.alias("x")))
        assert plan.count(unified.HUNK_HEADER) <= most


def test_lines_of_other_beginnings_and_empty_ones_are_not_settled_by_signs(spark):
    hunks = {
        "@@ -1,2 +1,2 @@\n a\n-b\n+c\n": True, "@@ -1,2 +1,2 @@\n a\n-b\n+c": True, "@@ -1,2 +1,2 @@ s\n a\n-b\n+c\n\\ No newline\n": True,
        "@@ -1 +1,2 @@\n a\n\n": False, "@@ -1 +1,2 @@\n a\n+b\nx\n": True, "@@ -1 +1,2 @@\n a\n-b\n": False, "@@ -1 +1 @@\n a\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n": True,
    }
    rows = spark.createDataFrame([(t,) for t in hunks], "t string").select("t", unified.hunk_is_consistent(F.col("t")).alias("ok")).collect()
    assert {r["t"]: r["ok"] for r in rows} == hunks


def test_bodies_of_few_levels_are_matched_whole_and_end_where_the_fold_ends(spark):
    random = Random(7)
    pieces = ["{", "}", "{", "}", ";", "\n", " a", "/", "//", "/*", "*/", '"', "'", "`", "\\", "é", "{}", ") {", "(b: i32)"]
    texts = ["".join(random.choices(pieces, k=random.randrange(24))) for _ in range(4000)]
    texts += ["{" * n + "x" + "}" * m for n in range(10) for m in range(10)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for spec in (JAVASCRIPT, RUST, GO):
        rows = df.select(
            "t", lexing.body_end(spec, F.col("t")).alias("end"), lexing.folded_body_end(spec, F.col("t")).alias("folded"),
            F.length(F.regexp_extract("t", lexing.body_pattern(spec), 0)).alias("whole"),
        ).collect()
        assert not [(r.t, r.end, r.folded) for r in rows if r.end != r.folded], spec.language
        assert sum(r.whole > 0 for r in rows) > 200 and sum(r.whole == 0 < r.folded for r in rows) > 5
