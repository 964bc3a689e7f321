"""The plans that matter at scale: what is shuffled, pruned and pushed down."""

import pytest
from pyspark.sql import functions as F

from revlake.operators import analytics as A
from revlake.operators import complexity as X
from revlake.operators import extraction as E
from revlake.operators import intake as W
from revlake.operators import listing as Q
from revlake.plans import review_run as P
from revlake.sources import readers

from test_extraction import diffs, new_file
from test_intake import SECRET, deliveries
from test_lists import review, reviews


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    diffs(spark, new_file("a.py", "def f(): pass"), "").write.parquet(str(folder / "diffs"))
    reviews(spark, review(1), review(2, repo="o/x")).write.parquet(str(folder / "reviews"))
    deliveries(spark).write.parquet(str(folder / "deliveries"))
    return folder


@pytest.mark.parametrize("keep_all", [False, True])
def test_diffs_to_scores_without_a_shuffle(spark, stored, keep_all):
    table = readers.read_diffs(spark, str(stored / "diffs"))
    found = X.score_functions(E.changed_functions(table, keep_all=keep_all), keep_all=keep_all)
    text = plan(found)
    assert "Exchange" not in text and "Window" not in text and "Python" not in text


def test_counts_read_diffs_once(spark, stored):
    table = readers.read_diffs(spark, str(stored / "diffs"))
    configs = spark.createDataFrame([], "repo_full_name string, " + ", ".join(
        ["cc_threshold int", "bandit_enabled boolean", "llm_provider string", "llm_model string",
         "auto_post boolean", "post_all_clear boolean", "exclude_patterns string"]))
    replies = spark.createDataFrame(
        [], "function_id string, result_name string, severity string, is_valid boolean"
    )
    outcomes = P.pr_outcomes(P.pr_activity(P.scored_results(table, configs, keep_all=True), replies))
    assert plan(outcomes).count("diff_text:string") == 1


def test_lists_are_top_k_with_pushed_filters(spark, stored):
    table = readers.read_reviews(spark, str(stored / "reviews"))
    text = plan(Q.list_reviews(table, repo="o/r").rows)
    assert "TakeOrderedAndProject" in text and "EqualTo(repo_full_name,o/r)" in text
    assert "Window" not in text


def test_figures_read_only_their_columns(spark, stored):
    table = readers.read_reviews(spark, str(stored / "reviews"))
    text = plan(A.dashboard_stats(table))
    assert "ReadSchema: struct<complexity_score:double,priority:string,status:string>" in text


def test_intake_is_row_local(spark, stored):
    table = readers.read_deliveries(spark, str(stored / "deliveries"))
    assert "Exchange" not in plan(W.jobs_from_deliveries(table, SECRET))


def test_partial_aggregation_before_the_shuffle(spark, stored):
    table = readers.read_reviews(spark, str(stored / "reviews"))
    text = plan(table.groupBy("repo_full_name").agg(F.count("*")))
    assert "partial_count" in text
    assert "partial_max_by" in plan(A.pr_cards(table))
