import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from revlake.languages import GO, LANGUAGES
from revlake.operators import comments as C
from revlake.operators import configs as G
from revlake.operators import triage as L
from revlake.operators.joins import lookup_join
from revlake.plans import review_run as P

from test_extraction import new_file

CONFIG = (
    "id long, repo_full_name string, cc_threshold int, bandit_enabled boolean, llm_provider string, "
    "llm_model string, auto_post boolean, post_all_clear boolean, exclude_patterns string"
)


def branchy(name, ifs):
    body = "".join(f"    if a > {i}:\n        a += 1\n" for i in range(ifs))
    return f"def {name}(a):\n{body}    return eval(a)"


def reply(**changes):
    fields = {"severity": "high", "issue_type": "data_loss", "summary": "loses rows", "explanation": "no flush"}
    fields.update(changes)
    return json.dumps({k: v for k, v in fields.items() if v is not None})


@pytest.fixture(scope="module")
def run(spark):
    prs = [
        ("org/a", 1, new_file("m.py", branchy("big", 12))),  # reviewed
        ("org/a", 2, new_file("m.py", branchy("big", 12))),  # gate keeps nothing: all clear
        ("org/a", 3, new_file("m.py", branchy("small", 2))),  # nothing to scan
        ("org/a", 4, new_file("m.md", "# text")),  # no functions
        ("org/a", 5, new_file("m.py", branchy("one", 12) + "\n" + branchy("two", 12))),  # bad reply: failed
        ("org/a", 6, "--- a/m.py\n+++ b/m.py\n@@ -1 +1,9 @@\n+def f(): pass\n"),  # bad diff: failed
        ("org/quiet", 7, new_file("m.py", branchy("big", 5))),  # stays pending, says nothing
        ("org/null", 8, new_file("m.py", branchy("big", 30))),  # null threshold flags nothing
        ("org/a", 9, new_file("m.py", branchy("big", 12))),  # no reply yet: waits
    ]
    diffs = spark.createDataFrame(
        [(r, n, f"title {n}", d) for r, n, d in prs],
        "repo_full_name string, pr_number long, pr_title string, diff_text string",
    )
    configs = spark.createDataFrame(
        [
            (1, "org/quiet", 4, False, "openai", None, False, True, "docs/*"),
            (2, "org/null", None, True, None, None, True, True, ""),
        ],
        CONFIG,
    )
    results = P.scored_results(diffs, configs)
    ids = {(r.pr_number, r.function_name): r.function_id for r in results.collect()}
    replies = [
        (1, "big", reply(suggested_fix="flush()")), (2, "big", reply(severity="medium")),
        (5, "one", reply(severity="critical")), (5, "two", reply(severity="awful")),
        (7, "big", reply(severity="critical", issue_type="crash")), (3, "small", reply()),
        (8, "big", reply()),
    ]
    responses = spark.createDataFrame(
        [(ids[n, f], f, text) for n, f, text in replies],
        "function_id string, result_name string, response_json string",
    )
    reports = spark.createDataFrame(
        [
            (ids[1, "big"], "bandit", '{"results":[{"test_id":"B1","issue_text":"risk","issue_severity":"HIGH"}]}'),
            (ids[7, "big"], "bandit", '{"results":[{"test_id":"B1"}]}'),
        ],
        "function_id string, tool string, stdout string",
    )
    commits = spark.createDataFrame(
        [("org/a", 1, 1, "old"), ("org/a", 1, 2, "new"), ("org/a", 2, 1, "x")],
        "repo_full_name string, pr_number long, commit_seq int, commit_sha string",
    )
    return P.review_run(diffs, configs, responses, reports, commits), (diffs, configs, responses)


def test_outcomes(run):
    rows = {r.pr_number: r for r in run[0].outcomes.collect()}
    assert {n: r.outcome for n, r in rows.items()} == {
        1: "reviewed", 2: "all_clear", 3: "nothing_to_scan", 4: "no_functions", 5: "failed", 6: "failed",
        7: "reviewed", 8: "nothing_to_scan", 9: "waiting",
    }
    assert {n: r.comment_kind for n, r in rows.items() if r.comment_kind} == {
        2: "all_clear", 3: "nothing_to_scan", 4: "nothing_to_scan", 8: "nothing_to_scan",
    }
    assert (rows[9].job_status, rows[9].reviews_posted, rows[9].message) == ("processing", 0, None)
    assert rows[5].error_message == P.BAD_REPLY and rows[6].error_message == P.BAD_DIFF
    assert rows[5].reviews_posted == 0 and rows[5].job_status == "failed"
    assert (rows[3].message, rows[4].message) == ("Analyzed 1 functions", "No analyzable functions changed")
    assert "Reviewed 1 function (python: 1). All" in rows[2].comment_body
    assert "Found 1 changed function, but none" in rows[3].comment_body
    assert "No function-level changes" in rows[4].comment_body


def test_reviews_are_all_or_nothing(run):
    rows = {r.pr_number: r for r in run[0].reviews.collect()}
    assert set(rows) == {1, 7}
    assert (rows[1].status, rows[7].status) == ("posted", "pending")
    assert (rows[1].pr_title, rows[1].priority, rows[1].complexity_score, rows[1].line_number) == (
        "title 1", "high", 13.0, 1,
    )
    assert "### Suggested fix\n```python\nflush()\n```\n" in rows[1].suggestion
    assert "- [B1] risk (severity: HIGH)\n" in rows[1].suggestion
    assert "scanner flags" not in rows[7].suggestion  # scanning is off there
    assert rows[1].suggestion.startswith("## 🔴 revlake — Data Loss (HIGH)\n\n**Function**: `big`\n")


def test_outbox_and_notifications(run):
    outbox = {(r.kind, r.pr_number): r for r in run[0].outbox.collect()}
    assert set(outbox) == {
        ("review", 1), ("all_clear", 2), ("nothing_to_scan", 3), ("nothing_to_scan", 4),
        ("nothing_to_scan", 8),
    }
    assert outbox["review", 1].commit_sha == "new" and outbox["review", 1].path == "m.py"
    assert len({r.outbox_key for r in outbox.values()}) == len(outbox)
    told = {json.loads(r.value)["pr_number"] for r in run[0].notifications.collect()}
    assert told == {1, 2, 3, 7, 8}


def test_job_transitions(spark, run):
    jobs = spark.createDataFrame(
        [("t1", "org/a", 1), ("t5", "org/a", 5), ("t9", "org/a", 9)], "celery_task_id string, repo_full_name string, pr_number long"
    )
    events = P.job_transitions(run[0].outcomes, jobs).collect()
    assert sorted((e.task_id, e.seq, e.status, e.error_message) for e in events) == [
        ("t1", 1, "processing", None), ("t1", 2, "complete", None),
        ("t5", 1, "processing", None), ("t5", 2, "failed", P.BAD_REPLY), ("t9", 1, "processing", None),
    ]


def test_rules_stand_in_for_reports_and_ids_repeat(run):
    diffs, configs, responses = run[1]
    again = P.review_run(diffs, configs, responses)
    rows = {r.pr_number: r for r in again.reviews.collect()}
    assert "- [eval-call] " in rows[1].suggestion and "scanner flags" not in rows[7].suggestion
    assert {r.id for r in rows.values()} == {r.id for r in run[0].reviews.collect()}


def test_a_language_is_a_record(spark):
    zig = replace(GO, language="zig", extensions=(".zig",))
    body = "".join(f"\tif a > {i} {{\n\t\ta++\n\t}}\n" for i in range(12))
    diffs = spark.createDataFrame(
        [("org/z", 1, "t", new_file("m.zig", f"func big(a int) int {{\n{body}\treturn a\n}}"))],
        "repo_full_name string, pr_number long, pr_title string, diff_text string",
    )
    configs = spark.createDataFrame([], CONFIG)
    specs = (*LANGUAGES, zig)
    (found,) = P.scored_results(diffs, configs, specs=specs).collect()
    assert (found.language, found.function_name, found.score, found.is_flagged) == ("zig", "big", 13, True)
    replies = spark.createDataFrame(
        [(found.function_id, "big", reply(severity="medium"))],
        "function_id string, result_name string, response_json string",
    )
    (outcome,) = P.review_run(diffs, configs, replies, specs=specs, staged=False).outcomes.collect()
    assert outcome.outcome == "all_clear" and "(zig: 1)" in outcome.comment_body


def test_exclusions_are_an_option(spark, run):
    diffs, configs, _ = run[1]
    patterns = configs.withColumn("exclude_patterns", F.lit("*.py"))
    kept = P.scored_results(diffs, patterns, apply_exclusions=True, keep_all=True)
    quiet = kept.filter(F.col("repo_full_name") == "org/quiet").collect()
    assert [(r.pr_number, r.function_name) for r in quiet] == [(7, None)]


def test_lookup_join_is_the_same_salted(spark):
    facts = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id"
    )
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", None)], "key string, v int")
    plain = lookup_join(facts, lookup, "key", F.col("id"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        salted = lookup_join(facts, lookup, "key", F.col("id"))
        assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
        assert salted.exceptAll(plain.select(salted.columns)).count() == 0
        assert salted.count() == plain.count() == 5000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_config_reads_and_patches(spark):
    configs = spark.createDataFrame([(1, "o/a", None, False, "openai", "m", True, False, "x")], CONFIG)
    repos = spark.createDataFrame([("o", "a"), ("o", "b")], "owner string, name string").select(
        G.repo_name(F.col("owner"), F.col("name")).alias("repo_full_name")
    )
    shown = {r.repo: r for r in G.read_configs(repos, configs).collect()}
    assert shown["o/a"].cc_threshold is None and shown["o/b"].cc_threshold == 15
    assert shown["o/b"].llm_provider == "proxy" and shown["o/b"].exclude_patterns == ""
    patches = spark.createDataFrame(
        [("o/a", 1, 7, None, None), ("o/a", 2, None, True, None), ("o/a", 3, 9, None, ""), ("o/c", 1, None, None, "ollama")],
        "repo_full_name string, seq long, cc_threshold int, bandit_enabled boolean, llm_provider string",
    )
    for name in G.FIELDS:
        if name not in patches.columns:
            patches = patches.withColumn(name, F.lit(None).cast(G.schemas.REPO_CONFIGS[name].dataType))
    rows = {r.repo_full_name: r for r in G.upsert_configs(configs, patches).collect()}
    assert (rows["o/a"].cc_threshold, rows["o/a"].bandit_enabled, rows["o/a"].llm_provider) == (9, True, "")
    assert rows["o/a"].exclude_patterns == "x" and rows["o/a"].post_all_clear is False
    assert (rows["o/c"].cc_threshold, rows["o/c"].llm_provider, rows["o/c"].auto_post) == (10, "ollama", True)


def test_replies(spark):
    texts = {
        "good": reply(), "fix": reply(suggested_fix="x"), "no summary": reply(summary=None),
        "bad enum": reply(severity="HIGH"), "bad type": reply(issue_type="style"), "broken": "{", "empty": "",
        "none": reply(severity="none", issue_type="none"),
    }
    df = spark.createDataFrame(
        [("f", k, v) for k, v in texts.items()], "function_id string, result_name string, response_json string"
    )
    valid = {r.result_name for r in L.validate_replies(df).collect() if r.is_valid}
    assert valid == {"good", "fix", "none"}
    kept = L.severity_gate(L.validate_replies(df).filter("is_valid"))
    assert {r.result_name for r in kept.collect()} == {"good", "fix"}


def test_prompt_and_providers(spark):
    row = spark.range(1).select(
        L.prompt_of(F.lit("f"), F.lit(12), F.lit("elm"), F.lit("f = {source}"), "{name}|{score}|{language}|{fence}|{source}|{x}").alias("p"),
    ).first()
    assert row.p == "f|12|elm|elm|f = {source}|{x}"
    asked = spark.createDataFrame(
        [(None, None), ("", "m"), ("openai", ""), ("nope", "m")], "llm_provider string, llm_model string"
    )
    rows = L.resolve_provider(asked).collect()
    assert [(r.provider, r.model, r.provider_error) for r in rows] == [
        ("proxy", L.schemas.MODEL_DEFAULT, None), ("proxy", "m", None), ("openai", "gpt-4o", None),
        ("nope", None, "Unknown LLM provider: nope"),
    ]
    keyless = L.resolve_provider(asked, keys_present=frozenset()).collect()
    assert keyless[0].provider_error == "No API key for provider: proxy" and keyless[2].model == "gpt-4o"


def test_comment_pieces(spark):
    style = C.CommentStyle("Bot", "bot")
    row = spark.range(1).select(
        C.review_comment(
            F.lit("f"), F.lit("go"), F.lit("medium"), F.lit("crash"), F.lit("s"), F.lit(None).cast("string"),
            F.lit("e"), F.lit(None).cast("array<string>"), style,
        ).alias("c"),
        C.all_clear_comment(F.lit(3), C.language_breakdown(F.expr(
            "array(named_struct('language','python','n',1), named_struct('language','go','n',2))")), style).alias("a"),
        C.all_clear_comment(F.lit(0), C.language_breakdown(F.expr(
            "cast(array() as array<struct<language:string,n:bigint>>)")), style).alias("z"),
        C.nothing_to_scan_comment(F.lit(2), style).alias("n"),
    ).first()
    assert row.c == (
        "## 🟡 Bot — Crash (MEDIUM)\n\n**Function**: `f`\n\n### What could go wrong\ns\n\n### Why\ne\n"
        "\n---\n*Bot triages production risks only — style and complexity feedback is intentionally filtered out.*"
    )
    assert row.a.startswith("<!-- bot:all-clear -->\n## ✓ Bot — No production risks found\n\n"
                            "Reviewed 3 functions (go: 2, python: 1). All within")
    assert "Reviewed 0 functions. All" in row.z
    assert "Found 2 changed functions, but" in row.n and row.n.startswith("<!-- bot:nothing-to-scan -->\n## ⊘ Bot")


def test_superseded_comments(spark):
    clear, nothing = C.STYLE.all_clear_marker, C.STYLE.nothing_to_scan_marker
    comments = spark.createDataFrame(
        [("r", 1, 1, clear), ("r", 1, 2, f"x {clear} y"), ("r", 1, 3, nothing), ("r", 1, 4, None),
         ("r", 2, 5, clear), ("r", 3, 6, nothing), ("r", 4, 7, "plain")],
        "repo_full_name string, pr_number long, comment_id long, body string",
    )
    fresh = spark.createDataFrame(
        [("r", 1, "all_clear"), ("r", 3, "nothing_to_scan"), ("r", 4, "all_clear")],
        "repo_full_name string, pr_number long, kind string",
    )
    gone = C.superseded_comments(comments, fresh)
    assert {(r.pr_number, r.deleted) for r in C.deleted_counts(gone).collect()} == {(1, 2), (3, 1)}
    assert {r.comment_id for r in C.surviving_comments(comments, gone).collect()} == {3, 4, 5, 7}
