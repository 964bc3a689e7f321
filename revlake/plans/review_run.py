"""One review run over a table of diffs.

Extraction and scoring are row-local. The first shuffle of the run moves scored
functions, never diffs or lines, and only as far as a join needs them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from revlake.functions.rules import rule_issues
from revlake.functions.text import pin
from revlake.languages import LANGUAGES, LanguageSpec
from revlake.operators import comments as C
from revlake.operators.complexity import score_functions
from revlake.operators.configs import with_run_config
from revlake.operators.diffs import PR_KEYS
from revlake.operators.extraction import changed_functions
from revlake.operators.security import gate_issues, issue_lists, issue_text, observed, security_issues
from revlake.operators.triage import POSTED_SEVERITIES, latest_replies, severity_gate, validate_replies
from revlake.sources.staging import stage

RESULT_KEYS = ("function_id", "result_name")

# PR outcomes.
NO_FUNCTIONS, NOTHING_TO_SCAN, ALL_CLEAR, REVIEWED, FAILED, WAITING = (
    "no_functions", "nothing_to_scan", "all_clear", "reviewed", "failed", "waiting",
)
BAD_REPLY = "triage reply does not meet the schema"
BAD_DIFF = "diff does not match its hunk headers"


TASK = "task_id"


def run_keys(df: DataFrame) -> tuple[str, ...]:
    """What tells runs apart: the job's task where the table has it, else the PR alone."""
    return (TASK, *PR_KEYS) if TASK in df.columns else PR_KEYS


def diffs_of_jobs(jobs: DataFrame, landed: DataFrame) -> DataFrame:
    """Diff rows of a run for each job: its PR, title and installation, and the diff landed for its task."""
    named = jobs.withColumnRenamed("celery_task_id", TASK)
    return named.select(TASK, *PR_KEYS, "pr_title", "installation_id").join(landed.select(TASK, "diff_text"), TASK)


def scored_results(
    diffs: DataFrame,
    configs: DataFrame,
    apply_exclusions: bool = False,
    keep_all: bool = False,
    **extraction,
) -> DataFrame:
    """Scored functions with their repository's settings and flag.

    With ``keep_all`` every PR has at least one row and carries ``diff_ok``, so
    this one table holds all that reviews and outcomes need from the diffs.
    """
    found = changed_functions(
        diffs, keys=run_keys(diffs), configs=configs if apply_exclusions else None, carry=("pr_title",),
        keep_all=keep_all, **extraction,
    )
    return flag_results(score_functions(found, extraction.get("specs", LANGUAGES), keep_all=keep_all), configs)


def flag_results(scored: DataFrame, configs: DataFrame) -> DataFrame:
    """Add run settings; a null threshold in a row flags nothing."""
    settled = with_run_config(scored, configs, F.col("function_id"))
    flagged = F.coalesce(F.col("score") > F.col("cc_threshold"), F.lit(False))
    return settled.withColumn("is_flagged", flagged)


def flagged_only(results: DataFrame) -> DataFrame:
    return results.filter(F.col("is_flagged"))


def pr_counts(results: DataFrame) -> DataFrame:
    """Changed functions and analyzed results per PR."""
    return results.groupBy(*run_keys(results)).agg(
        F.count_if(F.col("result_no") == 0).alias("function_count"),
        F.count_if("is_flagged").alias("analyzed_count"),
    )


def language_counts(results: DataFrame) -> DataFrame:
    """Analyzed results per PR and language."""
    return flagged_only(results).groupBy(*run_keys(results), "language").agg(F.count("*").alias("n"))


def findings(flagged: DataFrame, replies: DataFrame) -> DataFrame:
    """Flagged results whose valid reply passes the severity gate."""
    posted = severity_gate(replies.filter(F.col("is_valid"))).drop("is_valid")
    return flagged.join(posted, list(RESULT_KEYS))


def with_issue_lists(found: DataFrame, issues: DataFrame) -> DataFrame:
    """Attach each function's scanner issues; null when there are none."""
    lists = issue_lists(gate_issues(issues, found.select("function_id", "bandit_enabled")))
    return found.join(lists, "function_id", "left")


def with_rule_issues(flagged: DataFrame) -> DataFrame:
    """Attach what the built-in source rules find, inside each row.

    The source text is dropped here, so that no later join has to move it.
    """
    texts = F.transform(
        "issues", lambda i: issue_text(i["test_id"], i["description"], i["severity"])
    )
    wanted = F.coalesce(F.col("bandit_enabled"), F.lit(False)) & (F.size("issues") > 0)
    scanned = pin(flagged, issues=rule_issues(F.col("source_code"), F.col("language")))
    return scanned.withColumn("security_issues", F.when(wanted, texts)).drop("issues", "source_code")


def review_rows(
    found: DataFrame, style: C.CommentStyle = C.STYLE, created_at: Column | None = None
) -> DataFrame:
    """Findings as review rows."""
    body = C.review_comment(
        F.col("result_name"), F.col("language"), F.col("severity"), F.col("issue_type"),
        F.col("summary"), F.col("suggested_fix"), F.col("explanation"), F.col("security_issues"), style,
    )
    key = F.concat_ws(":", "function_id", "result_name")
    return found.select(
        F.xxhash64(key).alias("id"),
        F.sha2(key, 256).alias("review_key"),
        *run_keys(found),
        "pr_title",
        F.col("result_name").alias("function_name"),
        "file_path",
        F.col("start_line").alias("line_number"),
        F.col("score").cast("double").alias("complexity_score"),
        body.alias("suggestion"),
        F.col("severity").alias("priority"),
        F.when(F.col("auto_post"), "posted").otherwise("pending").alias("status"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def failed_prs(flagged: DataFrame, replies: DataFrame, parse_errors: DataFrame | None = None) -> DataFrame:
    """Runs that fail: a rejected reply to a flagged result, or a bad diff."""
    keys = run_keys(flagged)
    rejected = replies.filter(~F.col("is_valid")).select(*RESULT_KEYS)
    failed = flagged.join(rejected, list(RESULT_KEYS), "left_semi").select(*keys, F.lit(BAD_REPLY).alias("reason"))
    if parse_errors is not None:
        failed = failed.unionByName(parse_errors.select(*keys, "reason"))
    # A bad diff has no results, so a run has one reason at most.
    return failed.groupBy(*keys).agg(F.bool_or(F.col("reason") == BAD_REPLY).alias("_reply")).select(
        *keys, F.when(F.col("_reply"), BAD_REPLY).otherwise(BAD_DIFF).alias("error_message")
    )


def waiting_prs(flagged: DataFrame, replies: DataFrame) -> DataFrame:
    """Runs with a flagged result that nobody has replied to yet."""
    return flagged.join(replies.select(*RESULT_KEYS), list(RESULT_KEYS), "left_anti").select(*run_keys(flagged)).distinct()


def parse_failures(results: DataFrame) -> DataFrame:
    """Runs whose diff does not parse, from ``keep_all`` results."""
    return results.filter(~F.col("diff_ok")).select(*run_keys(results), F.lit(BAD_DIFF).alias("reason"))


def without_failed(reviews: DataFrame, failed: DataFrame) -> DataFrame:
    """All or nothing per run: one that failed, or still waits, keeps none of its reviews."""
    keys = run_keys(failed)
    return reviews.join(failed.select(*keys), list(keys), "left_anti")


def pr_activity(
    results: DataFrame, replies: DataFrame, specs: tuple[LanguageSpec, ...] = LANGUAGES
) -> DataFrame:
    """Everything an outcome needs, per run, from one grouping of ``keep_all`` results."""
    keys = run_keys(results)
    narrow = results.select(
        *keys, *RESULT_KEYS, "result_no", "language", "is_flagged", "diff_ok", "auto_post", "post_all_clear"
    )
    answers = replies.select(*RESULT_KEYS, "severity", "is_valid")
    # A row without a function keeps a function_id of its own, which matches no
    # reply and spreads such rows over all partitions.
    answered = narrow.join(answers, list(RESULT_KEYS), "left")
    flagged, valid = F.col("is_flagged"), F.col("is_valid")
    return answered.groupBy(*keys).agg(
        F.count_if(F.col("result_no") == 0).alias("function_count"),
        F.count_if(flagged).alias("analyzed_count"),
        F.count_if(flagged & valid & F.col("severity").isin(*POSTED_SEVERITIES)).alias("reviews_posted"),
        F.count_if(flagged & ~valid).alias("rejected_replies"),
        F.count_if(flagged & valid.isNull()).alias("missing_replies"),
        F.bool_and("diff_ok").alias("diff_ok"),
        F.bool_or("auto_post").alias("auto_post"),
        F.bool_or("post_all_clear").alias("post_all_clear"),
        *[F.count_if(flagged & (F.col("language") == s.language)).alias(f"n_{s.language}") for s in specs],
    )


def pr_outcomes(activity: DataFrame, style: C.CommentStyle = C.STYLE) -> DataFrame:
    """Outcome, PR-level comment and run summary of every run.

    A run whose flagged results do not all have a reply waits: it has no
    comment, posts nothing, and its job stays in processing.
    """
    keys = run_keys(activity)
    functions, analyzed, posted = (
        F.col(name) for name in ("function_count", "analyzed_count", "reviews_posted")
    )
    error = F.when(~F.col("diff_ok"), BAD_DIFF).when(F.col("rejected_replies") > 0, BAD_REPLY)
    outcome = (
        F.when(error.isNotNull(), FAILED)
        .when(functions == 0, NO_FUNCTIONS)
        .when((analyzed == 0) & (posted == 0), NOTHING_TO_SCAN)
        .when(F.col("missing_replies") > 0, WAITING)
        .when(posted == 0, ALL_CLEAR)
        .otherwise(REVIEWED)
    )
    counts = F.filter(
        F.array(
            *[F.struct(F.lit(c[2:]).alias("language"), F.col(c).alias("n")) for c in activity.columns if c.startswith("n_")]
        ),
        lambda c: c["n"] > 0,
    )
    speaks = F.coalesce(F.col("post_all_clear") & F.col("auto_post"), F.lit(False))
    base = activity.select(
        *keys,
        outcome.alias("outcome"),
        "function_count",
        "analyzed_count",
        F.when(outcome.isin(FAILED, WAITING), F.lit(0)).otherwise(posted).alias("reviews_posted"),
        error.alias("error_message"),
        speaks.alias("_speaks"),
        C.language_breakdown(counts).alias("_breakdown"),
    )
    is_nothing = F.col("outcome").isin(NO_FUNCTIONS, NOTHING_TO_SCAN)
    kind = F.when(F.col("_speaks") & is_nothing, "nothing_to_scan").when(
        F.col("_speaks") & (F.col("outcome") == ALL_CLEAR), "all_clear"
    )
    body = F.when(kind == "nothing_to_scan", C.nothing_to_scan_comment(F.col("function_count"), style)).when(
        kind == "all_clear", C.all_clear_comment(F.col("analyzed_count"), F.col("_breakdown"), style)
    )
    message = (
        F.when(F.col("outcome") == NO_FUNCTIONS, "No analyzable functions changed")
        .when(~F.col("outcome").isin(FAILED, WAITING), F.format_string("Analyzed %d functions", F.col("function_count")))
    )
    return base.select(
        *keys, "outcome", "function_count", "analyzed_count", "reviews_posted", "error_message",
        kind.alias("comment_kind"), body.alias("comment_body"), message.alias("message"),
        F.when(F.col("outcome") == FAILED, "failed").when(F.col("outcome") == WAITING, "processing")
        .otherwise("complete").alias("job_status"),
    )


def notifications(outcomes: DataFrame) -> DataFrame:
    """One message per finished run that had functions."""
    heard = outcomes.filter(~F.col("outcome").isin(NO_FUNCTIONS, FAILED, WAITING))
    event = F.struct(F.lit("reviews_updated").alias("event"), F.col("pr_number"))
    return heard.select(F.lit("reviews_updates").alias("key"), F.to_json(event).alias("value"))


def comment_outbox(
    reviews: DataFrame, outcomes: DataFrame, commits: DataFrame | None = None
) -> DataFrame:
    """Comments to deliver: line comments of posted reviews and PR-level ones.

    ``outbox_key`` repeats on a replay, so a comment can be delivered once.
    """
    keys = run_keys(outcomes)
    line_comments = reviews.filter(F.col("status") == "posted").select(
        F.lit("review").alias("kind"), *keys, "function_name", F.col("file_path").alias("path"),
        F.col("line_number").alias("line"), F.col("suggestion").alias("body"),
    )
    pr_level = outcomes.filter(F.col("comment_kind").isNotNull()).select(
        F.col("comment_kind").alias("kind"), *keys, F.lit(None).cast("string").alias("function_name"),
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"),
        F.col("comment_body").alias("body"),
    )
    parts = [F.col(c).cast("string") for c in ("kind", *keys, "path", "line", "function_name")]
    outbox = line_comments.unionByName(pr_level).withColumn(
        "outbox_key", F.sha2(F.concat_ws(":", *parts), 256)
    )
    outbox = outbox.select("outbox_key", "kind", *keys, "path", "line", "body")
    if commits is None:
        return outbox.withColumn("commit_sha", F.lit(None).cast("string"))
    # One commit row per PR; AQE splits a PR that holds most of the comments.
    return outbox.join(C.latest_commits(commits), list(PR_KEYS), "left")


def job_transitions(outcomes: DataFrame, jobs: DataFrame, ts: Column | None = None) -> DataFrame:
    """Status events to append for the jobs of ``outcomes``: by task where outcomes tell it, else by PR."""
    keys = run_keys(outcomes)
    found = outcomes.select(*keys, F.col("job_status"), F.col("error_message").alias("_error"))
    named = jobs.withColumnRenamed("celery_task_id", TASK)
    rows = named.select(TASK, *PR_KEYS).join(found, [TASK] if TASK in keys else list(PR_KEYS))
    when = F.current_timestamp() if ts is None else ts
    event = lambda seq, status, error: F.struct(
        F.lit(seq).cast("bigint").alias("seq"), status.alias("status"), error.cast("string").alias("error_message")
    )
    begun, done = event(1, F.lit("processing"), F.lit(None)), event(2, F.col("job_status"), F.col("_error"))
    events = F.when(F.col("job_status") == "processing", F.array(begun)).otherwise(F.array(begun, done))
    return rows.select(TASK, F.inline(events), when.alias("ts"))


@dataclass(frozen=True)
class ReviewRun:
    results: DataFrame
    reviews: DataFrame
    outcomes: DataFrame
    outbox: DataFrame
    notifications: DataFrame


def staged_results(diffs: DataFrame, configs: DataFrame, keep_text: bool = True, **extraction) -> DataFrame:
    """``keep_all`` results written to the shared checkpoint folder, with flagged functions' texts where they are kept.

    A plan that holds them several times holds every expression that takes a
    diff apart as often; a staged table is one scan wherever it is used.
    """
    results = scored_results(diffs, configs, keep_all=True, **extraction)
    text = F.when(F.col("is_flagged"), F.col("source_code")) if keep_text else F.lit(None).cast("string")
    return stage(results.withColumn("source_code", text), "results")


def review_run(
    diffs: DataFrame,
    configs: DataFrame,
    triage_responses: DataFrame,
    scan_reports: DataFrame | None = None,
    commits: DataFrame | None = None,
    style: C.CommentStyle = C.STYLE,
    staged: bool = True,
    keep_text: bool = False,
    report_counts: Observation | None = None,
    **extraction,
) -> ReviewRun:
    """Plan a whole run.

    The diffs are read in one pass. The run's outputs all start from the scored
    results, so those are written once to the shared checkpoint folder unless
    ``staged`` is false. Where diffs carry a ``task_id`` every task is a run of
    its own, else every PR is one. Without scanner reports the built-in source rules take
    their place. ``report_counts`` counts reports and unreadable ones per tool
    while the first of the reviews' jobs reads them (see ``observed_health``).
    """
    if staged:
        # Only source rules, or a caller who asks for it, read flagged functions' texts again.
        results = staged_results(diffs, configs, keep_text or scan_reports is None, **extraction)
    else:
        results = scored_results(diffs, configs, keep_all=True, **extraction)
    specs = extraction.get("specs", LANGUAGES)
    return run_of_results(results, triage_responses, scan_reports, commits, style, staged, report_counts, specs)


def run_of_results(
    results: DataFrame,
    triage_responses: DataFrame,
    scan_reports: DataFrame | None = None,
    commits: DataFrame | None = None,
    style: C.CommentStyle = C.STYLE,
    staged: bool = True,
    report_counts: Observation | None = None,
    specs: tuple[LanguageSpec, ...] = LANGUAGES,
) -> ReviewRun:
    """The run of results that are there already, for replies that depend on them."""
    replies = validate_replies(latest_replies(triage_responses))
    if staged:
        # Findings, failed and waiting runs and outcomes all read them: each reply is parsed once.
        replies = stage(replies, "replies")
    flagged = flagged_only(results)
    if scan_reports is None:
        found = findings(with_rule_issues(flagged), replies)
    else:
        if report_counts is not None:
            scan_reports = observed(scan_reports, report_counts)
        found = with_issue_lists(findings(flagged, replies), security_issues(scan_reports))
    failed = failed_prs(flagged, replies, parse_failures(results))
    unfinished = failed.select(*run_keys(failed)).unionByName(waiting_prs(flagged, replies))
    reviews = without_failed(review_rows(found, style), unfinished)
    outcomes = pr_outcomes(pr_activity(results, replies, specs), style)
    return ReviewRun(
        results, reviews, outcomes, comment_outbox(reviews, outcomes, commits), notifications(outcomes)
    )


