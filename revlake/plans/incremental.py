"""Registered queries of tables kept up to date, of runs that finish in a stream, and of deep pages."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlake import schemas
from revlake.operators import configs as G
from revlake.operators import intake as W
from revlake.operators import diffs as D
from revlake.operators import extraction as E
from revlake.operators import listing as Q
from revlake.operators import security
from revlake.operators import triage as L
from revlake.plans import review_run as P
from revlake.plans.registered import (
    _CODE, _JOB_STATUS, _NEWEST, _OUTCOME, _REVIEW_VIEW, _REVIEWS, QUERIES, _register, _run, _SORTED,
)
from revlake.sources import bindings as B
from revlake.sources import maintained as M
from revlake.sources.readers import read_landed_diffs, read_reviews, spread
from revlake.sources.sinks import append_job_events, append_reviews
from revlake.sources.staging import new_folder, stage
from revlake.streaming import runs as R
from revlake.streaming import streams as S

_BASE = "2024-01-01 00:00:00"


@_register(
    "stream_runs_finished",
    _OUTCOME + " SELECT repo_full_name, pr_number, outcome, reviews_posted::BIGINT AS reviews_posted, "
    "CASE WHEN outcome IN ('reviewed', 'all_clear') THEN 1 ELSE 0 END::BIGINT AS messages FROM spoken WHERE analyzed_count > 0",
)
def stream_runs_finished(spark, sf_dir):
    """Half of the replies come in a later batch; some results get an older reply as well."""
    folder, minutes = new_folder(spark, "stream-runs"), F.expr("interval 1 minute")
    results = stage(P.scored_results(B.diffs(spark, sf_dir), B.repo_configs(spark, sf_dir), keep_all=True).drop("source_code"), "results")
    base = F.lit(_BASE).cast("timestamp")
    flagged = R.flagged_rows(results).withColumn("flagged_at", base)
    flagged.write.parquet(f"{folder}/flagged")
    replies = stage(L.validate_replies(B.triage_responses(spark, sf_dir)).select(*P.RESULT_KEYS, "severity", "is_valid"), "replies")
    late = F.pmod(F.xxhash64("function_id"), F.lit(2)) == 0
    first = replies.filter(~late).withColumn("reply_seq", F.lit(2).cast("long"))
    # An older reply that comes late, and doesn't count.
    older = first.withColumns({"reply_seq": F.lit(1).cast("long"), "severity": F.lit("critical"), "is_valid": F.lit(False)})
    second = replies.filter(late).withColumn("reply_seq", F.lit(1).cast("long")).unionByName(older)
    # The stream takes all that has landed and goes on later, so a batch is as many files as its rows need.
    for batch, rows in enumerate((first, second)):
        rows.withColumn("replied_at", base + minutes * (1 + 30 * batch)).write.mode("append").parquet(f"{folder}/replies")
        left, right = (spark.readStream.schema(spark.read.parquet(f"{folder}/{t}").schema).parquet(f"{folder}/{t}") for t in ("flagged", "replies"))
        R.runs_stream(R.answered(left, right), f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    runs = M.read_version(spark, f"{folder}/out/{R.RUNS}", R.runs_schema(P.PR_KEYS))
    told = spark.read.schema("value string").json(f"{folder}/out/{R.MESSAGES}")
    told = S.update_events(told).groupBy("pr_number").agg(F.count("*").alias("messages"))
    return runs.join(told, "pr_number", "left").select(
        "repo_full_name", "pr_number", "outcome", "reviews_posted", F.coalesce("messages", F.lit(0)).alias("messages")
    )


@_register("stream_counts_merged", f"SELECT user_id % 50 AS worker, {_JOB_STATUS} AS status, count(*) AS n FROM events GROUP BY ALL")
def stream_counts_merged(spark, sf_dir):
    """Counts over several batches; the table keeps two versions at most."""
    folder = new_folder(spark, "stream-counts")
    events = B.table(spark, sf_dir, "events")
    events.repartition(4, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(events.schema).parquet(f"{folder}/in")
    rows = stream.select((F.col("user_id") % 50).alias("worker"), F.expr(_JOB_STATUS).alias("status"))
    counts = S.status_counts(rows, "worker", "status")
    S.merged_stream(counts, ("worker", "status"), f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    found = M.versions(spark, f"{folder}/out")
    if len(found) > M.KEPT or found[-1:] < [3]:
        raise RuntimeError(f"versions of the counts: {found}")
    return M.read_version(spark, f"{folder}/out", counts.schema)


@_register(
    "run_outputs_committed",
    _OUTCOME + ", seen AS (SELECT spoken.*, coalesce(CASE WHEN cfg.id IS NULL THEN TRUE ELSE cfg.auto_post END, FALSE) AS auto_post "
    "FROM spoken LEFT JOIN cfg USING (repo_full_name) WHERE pr_number % 3 <> 1) "
    "SELECT 'reviews' AS output, sum(reviews_posted)::BIGINT AS n FROM seen "
    "UNION ALL SELECT 'job_events', sum(CASE WHEN outcome = 'waiting' THEN 1 ELSE 2 END)::BIGINT FROM seen "
    "UNION ALL SELECT 'outbox', (sum(CASE WHEN auto_post THEN reviews_posted ELSE 0 END) + count(comment_kind))::BIGINT FROM seen "
    "UNION ALL SELECT 'notifications', count(*) FROM seen WHERE outcome NOT IN ('no_functions', 'failed', 'waiting')",
)
def run_outputs_committed(spark, sf_dir):
    """Three batches, of which the second stops between two writers: nothing of it is seen."""
    run, folder = _run(spark, sf_dir), new_folder(spark, "committed")
    reviews, outcomes = stage(run.reviews, "reviews"), stage(run.outcomes, "outcomes")
    jobs = outcomes.select(F.format_string("task-%d", F.col("pr_number")).alias("celery_task_id"), "repo_full_name", "pr_number")
    for batch in (0, 1, 2, 2):  # the last one comes twice
        own = F.col("pr_number") % 3 == batch
        parts = (
            reviews.filter(own), P.job_transitions(outcomes.filter(own), jobs.filter(own)),
            P.comment_outbox(reviews.filter(own), outcomes.filter(own)), P.notifications(outcomes.filter(own)),
        )
        if batch == 1:
            append_reviews(parts[0], f"{folder}/reviews", batch)
            append_job_events(parts[1], f"{folder}/job_events", batch)
        else:
            M.write_outputs(folder, batch, *parts)
    counts = None
    for name, schema, fmt in (
        ("reviews", schemas.REVIEWS, "parquet"), ("job_events", schemas.JOB_EVENTS, "parquet"),
        ("outbox", T.StructType([T.StructField("outbox_key", T.StringType())]), "parquet"),
        ("notifications", T.StructType([T.StructField("value", T.StringType())]), "json"),
    ):
        n = M.read_committed(spark, folder, name, schema, fmt).agg(F.lit(name).alias("output"), F.count("*").alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    return counts


@_register("config_patches_out_of_order", QUERIES["config_upsert"].sql)
def config_patches_out_of_order(spark, sf_dir):
    """Patches in three shuffled batches, the first of which comes again at the end."""
    path, patches = new_folder(spark, "registers"), B.config_patches(spark, sf_dir)
    fields = T.StructType([schemas.REPO_CONFIGS[f] for f in G.FIELDS])
    schema, merge = M.register_schema("repo_full_name", fields), M.merge_registers("repo_full_name", list(G.FIELDS))
    dealt = F.pmod(F.xxhash64("seq", F.lit("deal")), F.lit(3))
    for batch, part in enumerate((2, 0, 1, 2)):
        M.merge_batch(patches.filter(dealt == part), batch, path, schema, merge)
    registers = M.read_version(spark, path, schema)
    return G.upsert_configs(B.repo_configs(spark, sf_dir), registers.withColumn("seq", F.lit(1)))


@_register(
    "job_states_from_snapshot",
    _SORTED + ", ev AS (SELECT user_id::VARCHAR AS task_id, event_id AS seq, " + _JOB_STATUS + " AS status, "
    "CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error_message, date_trunc('hour', ts) AS since FROM events "
    "UNION ALL SELECT sha256(event_id::VARCHAR), 0, 'queued', NULL, ts FROM sorted WHERE disposition = 'enqueued'), "
    "last AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY since DESC, seq DESC) AS n, "
    "count(*) OVER (PARTITION BY task_id) AS events FROM ev) SELECT task_id, status, error_message, events FROM last WHERE n = 1",
)
def job_states_from_snapshot(spark, sf_dir):
    """Three batches of events, intake's ``queued`` ones among them, each merged into the states before it."""
    path = new_folder(spark, "job-states")
    queued = M.queued_events(W.jobs_from_deliveries(B.deliveries(spark, sf_dir), B.WEBHOOK_SECRET))
    events = stage(B.job_events(spark, sf_dir).unionByName(queued), "job-events")
    dealt = F.pmod(F.xxhash64("task_id", "seq"), F.lit(3))
    for batch in range(3):
        M.merge_batch(events.filter(dealt == batch), batch, path, M.JOB_STATES, M.merge_job_events)
    return M.read_version(spark, path, M.JOB_STATES).select("task_id", "status", "error_message", "events")


@_register(
    "list_reviews_deep_page",
    _REVIEWS + f", page AS (SELECT * FROM rev {_NEWEST} LIMIT 50 OFFSET (SELECT count(*) * 3 // 5 FROM rev)) SELECT {_REVIEW_VIEW} FROM page",
)
def list_reviews_deep_page(spark, sf_dir):
    reviews = B.reviews(spark, sf_dir)
    rest, skip = Q.deep_offset(reviews, reviews.count() * 3 // 5)
    return Q.review_view(Q.newest_first(rest).offset(skip).limit(Q.REVIEW_PAGE))


@_register(
    "landed_diffs_to_reviews",
    "WITH " + B.functions_cte() + " SELECT 'task-' || k AS task_id, repo_full_name, pr_number, 'installed ' || k AS pr_title, function_name, "
    "start_line AS line_number, 'posted' AS status FROM fns JOIN supplier ON k = s_suppkey",
)
def landed_diffs_to_reviews(spark, sf_dir):
    """From landed files and stored jobs to stored reviews: a file a task under a name of Spark's own, told by a manifest."""
    folder = new_folder(spark, "landed")
    suppliers = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pr_number"))
    code = stage(B.diffs(spark, sf_dir).join(suppliers, "pr_number", "left_semi"), "landed-code")
    task = F.format_string("task-%d", "pr_number")
    # A character that no diff has closes each file, so that no line end is added.
    code.select(task.alias("task"), "diff_text").write.partitionBy("task").option("lineSep", "\x00").text(f"{folder}/files")
    listed = spark.read.format("binaryFile").load(f"{folder}/files").select(F.col("path").alias("file_path"))
    listed.withColumn("task_id", F.regexp_extract("file_path", "/task=([^/]+)/", 1)).write.parquet(f"{folder}/manifest")
    titles = F.format_string("installed %d", "pr_number").alias("pr_title")
    jobs = code.select(task.alias("celery_task_id"), *P.PR_KEYS, titles, F.lit(7).cast("long").alias("installation_id"))
    landed = read_landed_diffs(spark, f"{folder}/files", spark.read.parquet(f"{folder}/manifest"))
    diffs = P.diffs_of_jobs(jobs, landed.withColumn("diff_text", F.replace("diff_text", F.lit("\x00"), F.lit(""))))
    # Settings that flag every function, and a reply that posts each.
    own = {"repo_full_name": F.col("repo_full_name"), "cc_threshold": F.lit(0), "auto_post": F.lit(True)}
    settings = jobs.select("repo_full_name").distinct().select(
        *(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.REPO_CONFIGS)
    )
    reply = '{"severity": "high", "issue_type": "crash", "summary": "s", "suggested_fix": null, "explanation": "e"}'
    flagged = P.flagged_only(P.scored_results(diffs, settings))
    run = P.review_run(diffs, settings, flagged.select(*P.RESULT_KEYS, F.lit(reply).alias("response_json")))
    append_reviews(run.reviews, f"{folder}/reviews", 0)
    return read_reviews(spark, f"{folder}/reviews").select(
        "task_id", "repo_full_name", "pr_number", "pr_title", "function_name", "line_number", "status"
    )


@_register(
    "report_unreadable_observed",
    _CODE + " SELECT CASE language WHEN 'python' THEN 'bandit' WHEN 'javascript' THEN 'eslint_security' WHEN 'rust' THEN 'clippy' ELSE 'gosec' END AS tool, "
    "count(*) AS reports, count(CASE WHEN k % 13 = 0 THEN 1 END) AS unreadable FROM code WHERE language IS NOT NULL GROUP BY language",
)
def report_unreadable_observed(spark, sf_dir):
    """Counted while a run's reviews are written, without reading the reports again."""
    counts = Observation("report health")
    run = P.review_run(
        B.diffs(spark, sf_dir), B.repo_configs(spark, sf_dir), B.triage_responses(spark, sf_dir), B.scan_reports(spark, sf_dir), report_counts=counts
    )
    append_reviews(run.reviews, new_folder(spark, "observed"), 0)
    return security.observed_health(spark, counts)


@_register(
    "source_rule_scan_many_rules",
    _CODE + " SELECT pr_number, 'part-' || k AS test_id, 1 AS line_number FROM code JOIN part ON p_partkey = k WHERE language IS NOT NULL",
)
def source_rule_scan_many_rules(spark, sf_dir):
    """A rule for every part: the name of one generated function."""
    key = F.col("p_partkey").cast("string")
    rules = B.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), key).alias("rule_id"), F.lit(None).cast("string").alias("language"), F.concat(F.lit("f"), key, F.lit("(")).alias("needle"),
        F.concat(F.lit(r"\bf"), key, F.lit(r"\s*\(")).alias("pattern"), F.lit("LOW").alias("severity"), F.lit("HIGH").alias("confidence"),
        F.lit("generated name").alias("description"),
    )
    index = stage(security.rule_index(rules), "rule-index")
    found = E.changed_functions(B.diffs(spark, sf_dir)).select("pr_number", F.col("language").alias("text_language"), "source_code")
    found = stage(found, "functions")
    hits = security.scan_with_rule_table(found, "pr_number", "source_code", "text_language", index)
    return hits.select("pr_number", "test_id", "line_number")


# Pattern sets by customer, and what they leave out in SQL.
_GLOBS = (
    "'src/F/*, *' || c_custkey || '.md'", "'*.rs, docs/*'", "'src/*/f*' || c_custkey % 10 || '*.py, gone/' || c_custkey", "'src/[FO]/f??.go, **/f*7.js'", "''",
)
_LEFT_OUT = (
    "file_path LIKE 'src/F/%' OR file_path LIKE '%' || o_custkey || '.md'", "file_path LIKE '%.rs'", "file_path LIKE 'src/%/f%' || o_custkey % 10 || '%.py'",
    "regexp_full_match(file_path, 'src/[FO]/f..\\.go') OR file_path LIKE '%/f%7.js'", "FALSE",
)


@_register(
    "path_exclusion_many_repositories",
    _CODE + " SELECT 'org/c' || o_custkey AS repo_full_name, pr_number, file_path FROM code WHERE NOT CASE o_custkey % 5 "
    + " ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(_LEFT_OUT)) + " END",
)
def path_exclusion_many_repositories(spark, sf_dir):
    """A pattern set for every customer's repository."""
    sets = "CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(_GLOBS)) + " END"
    repo = lambda key: F.concat(F.lit("org/c"), F.col(key).cast("string")).alias("repo_full_name")
    customers = spread(B.table(spark, sf_dir, "customer").select("c_custkey"))
    configs = customers.select(repo("c_custkey"), F.expr(sets).alias("exclude_patterns"))
    files = B.orders_code(spark, sf_dir).select(repo("o_custkey"), "pr_number", "file_path")
    return D.drop_excluded(files, configs)
