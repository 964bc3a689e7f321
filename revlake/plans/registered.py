"""The registered queries, each with the SQL that states its expected result.

Expected results come from the keys and counts of the source tables and never
from reading generated text, so they check the operators independently.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.functions.lexing import blank_literals, match_arms
from revlake.functions.rules import HARDCODED_SECRET, SOURCE_RULES
from revlake.functions.signing import key_pads, sign_body, signature_is_valid
from revlake.languages import GO, JAVASCRIPT, PYTHON, RUST
from revlake.operators import analytics as A
from revlake.operators import comments as C
from revlake.operators import complexity as X
from revlake.operators import configs as G
from revlake.operators import diffs as D
from revlake.operators import extraction as E
from revlake.operators import intake as W
from revlake.operators import listing as Q
from revlake.operators import security as S
from revlake.operators import triage as L
from revlake.plans import review_run as P
from revlake.sources import bindings as B
from revlake.sources.readers import read_reviews, spread
from revlake.sources.sinks import append_reviews, latest_version
from revlake.sources.staging import new_folder, stage
from revlake.streaming import streams as T

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    build: Build
    sql: str | None


QUERIES: dict[str, Registered] = {}


def _register(name: str, sql: str | None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[name] = Registered(build, sql)
        return build

    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CODE = "WITH " + B.code_cte()
_FUNCTIONS = "WITH " + B.functions_cte()
_FUNCTION_COLUMNS = "repo_full_name, pr_number, file_path, function_name, start_line, end_line, language"

_RESULTS = (
    _FUNCTIONS + ", " + B.CONFIGS_CTE + ", res AS ("
    "SELECT fns.*, CASE WHEN cfg.id IS NULL THEN 10 ELSE cfg.cc_threshold END AS cc_threshold, "
    "CASE WHEN cfg.id IS NULL THEN TRUE ELSE cfg.bandit_enabled END AS bandit_enabled, "
    "CASE WHEN cfg.id IS NULL THEN NULL ELSE cfg.llm_provider END AS llm_provider, "
    "CASE WHEN cfg.id IS NULL THEN NULL ELSE cfg.llm_model END AS llm_model, "
    "CASE WHEN cfg.id IS NULL THEN TRUE ELSE cfg.auto_post END AS auto_post, "
    "CASE WHEN cfg.id IS NULL THEN TRUE ELSE cfg.post_all_clear END AS post_all_clear, "
    "coalesce(score > CASE WHEN cfg.id IS NULL THEN 10 ELSE cfg.cc_threshold END, FALSE) AS is_flagged "
    "FROM fns LEFT JOIN cfg ON fns.repo_full_name = cfg.repo_full_name)"
)
_RANK = (
    "CASE WHEN score <= 5 THEN 'A' WHEN score <= 10 THEN 'B' WHEN score <= 20 THEN 'C' "
    "WHEN score <= 30 THEN 'D' ELSE 'F' END"
)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scored_results(B.diffs(spark, sf_dir), B.repo_configs(spark, sf_dir))


# --- diffs and files ------------------------------------------------------------

_HUNKS = (
    _CODE + ", hunks AS ("
    "SELECT pr_number, file_path AS path, 0 AS hunk, start_1 AS first_line, "
    f"coalesce({B.FIRST_LINES_SQL}, 3) AS n, 1 AS removed FROM code "
    f"UNION ALL SELECT pr_number, file_path, 1, start_2, CASE WHEN language IS NULL THEN 1 ELSE {B.SECOND_LINES_SQL} END, 0 "
    "FROM code WHERE has_second = 1 "
    "UNION ALL SELECT pr_number, 'docs/n' || k || '.md', 0, 1, 1, 0 FROM code WHERE has_doc = 1)"
)


@_register(
    "diff_added_lines",
    _HUNKS + " SELECT pr_number, path, hunk, n::BIGINT AS added, first_line, first_line + n - 1 AS last_line FROM hunks",
)
def diff_added_lines(spark, sf_dir):
    lines = D.diff_added_lines(B.diffs(spark, sf_dir))
    return lines.groupBy("pr_number", "path", "hunk").agg(
        F.count("*").alias("added"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    )


@_register(
    "diff_line_kinds",
    _HUNKS + " SELECT pr_number, path, sum(n)::BIGINT AS added, "
    "sum(CASE WHEN path LIKE 'docs/%' THEN 0 ELSE 2 END)::BIGINT AS context, sum(removed)::BIGINT AS removed, "
    "max(CASE WHEN path LIKE 'docs/%' THEN 1 ELSE first_line + n END) AS last_target FROM hunks GROUP BY pr_number, path",
)
def diff_line_kinds(spark, sf_dir):
    kind = F.col("kind")
    return D.diff_lines(B.diffs(spark, sf_dir)).groupBy("pr_number", "path").agg(
        F.count_if(kind == "+").alias("added"),
        F.count_if(kind == " ").alias("context"),
        F.count_if(kind == "-").alias("removed"),
        F.max("target_line").alias("last_target"),
    )


@_register(
    "language_dispatch",
    _CODE + " SELECT pr_number, file_path, language FROM code "
    "UNION ALL SELECT pr_number, 'docs/n' || k || '.md', NULL FROM code WHERE has_doc = 1",
)
def language_dispatch(spark, sf_dir):
    files = D.diff_files(B.diffs(spark, sf_dir))
    return files.select("pr_number", "file_path", D.language_of(F.col("file_path")).alias("language"))


@_register(
    "supported_languages",
    _CODE + " SELECT language, count(*) AS files FROM code WHERE language IS NOT NULL GROUP BY language",
)
def supported_languages(spark, sf_dir):
    files = D.supported_files(D.diff_files(B.diffs(spark, sf_dir)))
    counted = files.groupBy("language").agg(F.count("*").alias("files"))
    named = D.supported_languages(spark).join(counted, "language", "left")
    return named.select("language", F.coalesce("files", F.lit(0)).alias("files"))


@_register(
    "path_exclusion",
    _CODE + ", " + B.CONFIGS_CTE + ", files AS (SELECT repo_full_name, pr_number, file_path FROM code "
    "UNION ALL SELECT repo_full_name, pr_number, 'docs/n' || k || '.md' FROM code WHERE has_doc = 1) "
    "SELECT files.* FROM files LEFT JOIN cfg ON files.repo_full_name = cfg.repo_full_name "
    "WHERE NOT coalesce(cfg.exclude_patterns <> '' AND (file_path LIKE 'docs/%' OR file_path LIKE 'src/F/%.rs'), FALSE)",
)
def path_exclusion(spark, sf_dir):
    files = D.diff_files(B.diffs(spark, sf_dir))
    kept = D.drop_excluded(files, B.repo_configs(spark, sf_dir))
    return kept.select("repo_full_name", "pr_number", "file_path")


_ODD_GLOBS = (
    "src/[abc", "src/[!F]/*", "src/[O-F]/*, src/F/f?[!0-4]*", "src/(F|O)/*, **.rs", "docs/n[1\\2]*, src/{a,b",
)


@_register(
    "path_exclusion_odd_globs",
    _CODE + ", files AS (SELECT repo_full_name, pr_number, file_path, o_custkey % 5 AS odd FROM code "
    "UNION ALL SELECT repo_full_name, pr_number, 'docs/n' || k || '.md', o_custkey % 5 FROM code WHERE has_doc = 1) "
    "SELECT repo_full_name, pr_number, file_path FROM files WHERE NOT CASE odd WHEN 0 THEN FALSE "
    "WHEN 1 THEN file_path LIKE 'src/%' AND file_path NOT LIKE 'src/F/%' "
    "WHEN 2 THEN regexp_full_match(file_path, 'src/F/f.[^0-4].*') WHEN 3 THEN file_path LIKE '%.rs' "
    "ELSE file_path LIKE 'docs/n1%' OR file_path LIKE 'docs/n2%' END",
)
def path_exclusion_odd_globs(spark, sf_dir):
    n = F.col("n_nationkey")
    odd = F.element_at(F.array(*[F.lit(g) for g in _ODD_GLOBS]), (n % 5 + 1).cast("int"))
    configs = B.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("org/r"), n.cast("string")).alias("repo_full_name"), odd.alias("exclude_patterns")
    )
    kept = D.drop_excluded(D.diff_files(B.diffs(spark, sf_dir)), configs)
    return kept.select("repo_full_name", "pr_number", "file_path")


@_register(
    "language_lookup",
    _CODE + " SELECT pr_number, language FROM (SELECT pr_number, language FROM code)",
)
def language_lookup(spark, sf_dir):
    names = F.element_at(
        F.array(*[F.lit(n) for n in ("python", "javascript", "rust", "go", "cobol")]),
        (F.col("k") % 5 + 1).cast("int"),
    )
    return B.orders_code(spark, sf_dir).select("pr_number", D.known_language(names).alias("language"))


@_register(
    "diff_errors",
    _CODE + " SELECT repo_full_name, pr_number, " + _quoted(P.BAD_DIFF) + " AS reason FROM code WHERE k % 9 = 0",
)
def diff_errors(spark, sf_dir):
    # Cutting off the closing context line leaves the last hunk short of its header.
    text = F.col("diff_text")
    cut = F.substring(text, F.lit(1), F.length(text) - len(" after\n"))
    broken = F.when(F.col("pr_number") % 9 == 0, cut).otherwise(text)
    return D.diff_errors(B.diffs(spark, sf_dir).withColumn("diff_text", broken))


# --- functions and complexity -----------------------------------------------------


def _register_language(spec) -> None:
    @_register(
        f"changed_functions_{spec.language}",
        _FUNCTIONS + f" SELECT {_FUNCTION_COLUMNS} FROM fns WHERE language = '{spec.language}'",
    )
    def functions(spark, sf_dir):
        found = E.changed_functions(B.diffs(spark, sf_dir), specs=(spec,))
        return found.select(*_FUNCTION_COLUMNS.split(", "))

    @_register(
        f"complexity_{spec.language}",
        _FUNCTIONS + " SELECT pr_number, function_name AS result_name, score, score > 8 AS is_flagged "
        f"FROM fns WHERE language = '{spec.language}'",
    )
    def complexity(spark, sf_dir):
        found = E.changed_functions(B.diffs(spark, sf_dir), specs=(spec,))
        sources = found.select("pr_number", "language", "source_code")
        return X.analyze_sources(sources, 8, specs=(spec,)).select(
            "pr_number", "result_name", "score", "is_flagged"
        )


for _spec in (PYTHON, JAVASCRIPT, RUST, GO):
    _register_language(_spec)


@_register(
    "changed_functions_all",
    _FUNCTIONS + f" SELECT {_FUNCTION_COLUMNS} FROM fns",
)
def changed_functions_all(spark, sf_dir):
    return E.changed_functions(B.diffs(spark, sf_dir)).select(*_FUNCTION_COLUMNS.split(", "))


@_register(
    "changed_functions_file_first",
    _FUNCTIONS + " SELECT pr_number, function_name, start_1 AS start_line, "
    "start_1 + (end_line - start_line) + CASE WHEN language = 'python' THEN 1 ELSE 0 END "
    "AS end_line FROM fns",
)
def changed_functions_file_first(spark, sf_dir):
    found = E.changed_functions(B.diffs(spark, sf_dir), line_mode="file_first")
    return found.select("pr_number", "function_name", "start_line", "end_line")


@_register(
    "changed_functions_unclosed",
    "WITH u AS (SELECT c_custkey AS k, 70 + c_custkey % 10 AS m FROM customer) "
    "SELECT k AS pr_number, 'f1' AS function_name, 1 AS start_line, (2 * m + 3)::INTEGER AS end_line FROM u WHERE k % 3 = 0 "
    "UNION ALL SELECT k, 'last', (2 * m + 1)::INTEGER, (2 * m + 3)::INTEGER FROM u WHERE k % 3 <> 0 "
    "UNION ALL SELECT k, 'f' || i, (2 * i - 1)::INTEGER, (2 * m + 3)::INTEGER FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM u WHERE k % 3 = 2)",
)
def changed_functions_unclosed(spark, sf_dir):
    return E.changed_functions(B.unclosed_diffs(spark, sf_dir)).select("pr_number", "function_name", "start_line", "end_line")


@_register(
    "changed_functions_several_files",
    "WITH s AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 0) "
    + " UNION ALL ".join(
        f"SELECT k AS pr_number, 'src/{path}' || k || '{ext}' AS file_path, '{name}' || k AS function_name, {start} AS start_line, {end} AS end_line FROM s"
        for path, ext, name, start, end in (
            ("n", ".js", "outer", 1, 4), ("n", ".js", "twice", 5, 5), ("r", ".rs", "defined", 3, 5), ("g", ".go", "one", 5, 7), ("g", ".go", "two", 61, 62),
        )
    ),
)
def changed_functions_several_files(spark, sf_dir):
    found = E.changed_functions(B.several_file_diffs(spark, sf_dir))
    return found.select("pr_number", "file_path", "function_name", "start_line", "end_line")


@_register(
    "rust_match_arms",
    _FUNCTIONS + " SELECT pr_number, function_name, CASE WHEN function_name LIKE 'f%' THEN 6 * n_match ELSE 0 END AS arms "
    "FROM fns WHERE language = 'rust'",
)
def rust_match_arms(spark, sf_dir):
    found = E.changed_functions(B.diffs(spark, sf_dir), specs=(RUST,))
    blanked = found.select("pr_number", "function_name", blank_literals(RUST, F.col("source_code")).alias("code"))
    return blanked.select("pr_number", "function_name", match_arms(F.col("code")).alias("arms"))


@_register(
    "rank_and_flag",
    _RESULTS + f" SELECT pr_number, function_name AS result_name, score, {_RANK} AS rank, cc_threshold, is_flagged FROM res",
)
def rank_and_flag(spark, sf_dir):
    return _results(spark, sf_dir).select(
        "pr_number", "result_name", "score", "rank", "cc_threshold", "is_flagged"
    )


@_register(
    "flagged_by_language",
    _RESULTS + " SELECT repo_full_name, language, count(*) AS functions, "
    "count(CASE WHEN is_flagged THEN 1 END) AS flagged, max(score) AS top_score FROM res "
    "GROUP BY repo_full_name, language",
)
def flagged_by_language(spark, sf_dir):
    """Flagged functions per repository and language: the flagship query."""
    return _results(spark, sf_dir).groupBy("repo_full_name", "language").agg(
        F.count_if(F.col("result_no") == 0).alias("functions"),
        F.count_if("is_flagged").alias("flagged"),
        F.max("score").alias("top_score"),
    )


@_register(
    "go_package_clause",
    "WITH " + B.functions_cte() + " SELECT pr_number, function_name, "
    "CASE WHEN k % 2 = 0 THEN 'package own' ELSE 'package main' END AS clause, 1 AS clauses FROM fns WHERE language = 'go'",
)
def go_package_clause(spark, sf_dir):
    # Every other source comes with its own clause.
    found = E.changed_functions(B.diffs(spark, sf_dir), specs=(GO,))
    own = F.when(F.col("pr_number") % 2 == 0, F.concat(F.lit("package own\n"), F.col("source_code"))).otherwise(F.col("source_code"))
    source = X.go_with_package(own)
    return found.select(
        "pr_number", "function_name", F.substring_index(source, "\n", 1).alias("clause"),
        F.regexp_count(source, F.lit(r"(?m)^\s*package\s+\w+")).alias("clauses"),
    )


# --- reports --------------------------------------------------------------------


def _register_report(tool: str) -> None:
    @_register(
        f"report_{tool}",
        _CODE + ", " + B.REPORTS_CTE + " SELECT function_id, test_id, description, severity, confidence, line_number "
        f"FROM issues WHERE tool = '{tool}'",
    )
    def report(spark, sf_dir):
        return S.security_issues(B.scan_reports(spark, sf_dir), tool).select(
            "function_id", *S.ISSUE_FIELDS
        )


for _tool in ("bandit", "gosec", "eslint_security", "clippy"):
    _register_report(_tool)


@_register(
    "report_unreadable",
    _CODE + " SELECT CASE language WHEN 'python' THEN 'bandit' WHEN 'javascript' THEN 'eslint_security' "
    "WHEN 'rust' THEN 'clippy' ELSE 'gosec' END AS tool, count(*) AS reports, "
    "count(CASE WHEN k % 13 = 0 OR k % 13 = 1 AND language <> 'rust' THEN 1 END) AS unreadable "
    "FROM code WHERE language IS NOT NULL GROUP BY language "
    "UNION ALL SELECT CASE language WHEN 'go' THEN 'gocyclo' ELSE 'eslint_complexity' END, count(*), "
    "count(CASE WHEN k % 13 = 0 THEN 1 END) FROM code WHERE language IN ('go', 'javascript') GROUP BY language",
)
def report_unreadable(spark, sf_dir):
    # Some reports go on behind their JSON; a report by line just has one more bad line then.
    scans = B.scan_reports(spark, sf_dir, ("pr_number",)).withColumn(
        "stdout", F.when(F.col("pr_number") % 13 == 1, F.concat("stdout", F.lit(" trailing"))).otherwise(F.col("stdout"))
    )
    return S.report_health(scans.drop("pr_number").unionByName(B.complexity_tool_reports(spark, sf_dir).drop("repo_full_name")))


_TOOL_RESULTS = (
    _CODE + ", tool_results AS (SELECT " + B.FUNCTION_ID_SQL + " AS function_id, 'gocyclo' AS tool, "
    "'f' || k AS result_name, (2 + k % 40)::INTEGER AS score FROM code WHERE language = 'go' AND k % 13 <> 0 "
    "UNION ALL SELECT " + B.FUNCTION_ID_SQL + ", 'gocyclo', '(*T).m' || k, (3 + k % 40)::INTEGER FROM code "
    "WHERE language = 'go' AND k % 13 <> 0 "
    "UNION ALL SELECT " + B.FUNCTION_ID_SQL + ", 'eslint_complexity', "
    "CASE WHEN k % 4 = 3 THEN 'anonymous' ELSE 'f' || k END, (2 + k % 40)::INTEGER FROM code "
    "WHERE language = 'javascript' AND k % 13 <> 0)"
)


def _register_tool(tool: str) -> None:
    @_register(
        f"report_{tool}",
        _TOOL_RESULTS + f" SELECT function_id, result_name, score, {_RANK} AS rank, score > 10 AS is_flagged "
        f"FROM tool_results WHERE tool = '{tool}'",
    )
    def report(spark, sf_dir):
        reports = B.complexity_tool_reports(spark, sf_dir).filter(F.col("tool") == tool)
        return S.complexity_reports(reports, 10).drop("tool")


for _tool in ("gocyclo", "eslint_complexity"):
    _register_tool(_tool)


@_register(
    "secret_rule_scan",
    "WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, "
    "generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents) "
    "SELECT doc_id, 'hardcoded-secret' AS test_id, 'LOW' AS severity, line_number::INTEGER AS line_number FROM lines "
    f"WHERE regexp_matches(line, {_quoted(HARDCODED_SECRET.pattern)})",
)
def secret_rule_scan(spark, sf_dir):
    documents = spread(B.table(spark, sf_dir, "documents").select("doc_id", "text"))
    hits = S.scan_texts(documents, "doc_id", "text", (HARDCODED_SECRET,))
    return hits.select("doc_id", "test_id", "severity", "line_number")


# Lines written into order texts, by modulus, and the rule each must trigger.
_RULE_LINES = (
    (2, "password = 'short'", None, None),  # too short for a secret
    (3, "api_key: 'abcdef0123'", "hardcoded-secret", "any"),
    (4, "value = eval(data)", "eval-call", "python"),
    (4, "value = eval(data)", "security/detect-eval-with-expression", "javascript"),
    (5, "re = new RegExp(pattern)", "security/detect-non-literal-regexp", "javascript"),
    (6, "re = /(a+)+b/", "security/detect-unsafe-regex", "javascript"),
    (7, "crypto.pseudoRandomBytes(8)", "security/detect-pseudoRandomBytes", "javascript"),
    (8, "buf = new Buffer(8)", "security/detect-new-buffer", "javascript"),
    (9, "cp = require('child_process')", "security/detect-child-process", "javascript"),
    (10, "row[field] = 1", "security/detect-object-injection", "javascript"),
)
_RULE_HITS = " UNION ALL ".join(
    f"SELECT pr_number, '{rule}' AS test_id, "
    + " + ".join(f"(k % {m} = 0)::INTEGER" for m in sorted({m for m, *_ in _RULE_LINES if m <= modulus}))
    + f" AS line_number FROM code WHERE k % {modulus} = 0 AND "
    + ("language IS NOT NULL" if language == "any" else f"language = '{language}'")
    for modulus, _, rule, language in _RULE_LINES
    if rule
)


@_register("source_rule_scan", _CODE + " " + _RULE_HITS)
def source_rule_scan(spark, sf_dir):
    k = F.col("k")
    lines = dict((modulus, line) for modulus, line, *_ in _RULE_LINES)
    text = F.concat_ws("\n", *[F.when(k % m == 0, lines[m]) for m in sorted(lines)])
    code = B.orders_code(spark, sf_dir)
    sources = code.select(
        "pr_number", D.language_of(F.col("file_path")).alias("language"), text.alias("source_code")
    ).filter(F.col("language").isNotNull())
    scanned = S.scan_functions(sources)
    return scanned.select("pr_number", F.inline("issues")).select("pr_number", "test_id", "line_number")


_FLAGGED_ISSUES = (
    _RESULTS + ", " + B.REPORTS_CTE + ", kept AS (SELECT issues.*, pr_number FROM issues JOIN ("
    "SELECT " + B.FUNCTION_ID_SQL + " AS function_id, pr_number, bandit_enabled FROM res "
    "WHERE is_flagged AND function_name LIKE 'f%') f USING (function_id) WHERE bandit_enabled)"
)


@_register(
    "issue_text",
    _CODE + ", " + B.REPORTS_CTE + " SELECT function_id, line_number, "
    "'[' || test_id || '] ' || description || ' (severity: ' || severity || ')' AS issue FROM issues",
)
def issue_text(spark, sf_dir):
    issues = S.security_issues(B.scan_reports(spark, sf_dir))
    text = S.issue_text(F.col("test_id"), F.col("description"), F.col("severity"))
    return issues.select("function_id", "line_number", text.alias("issue"))


@_register(
    "scan_gate",
    _FLAGGED_ISSUES + " SELECT function_id, string_agg('[' || test_id || '] ' || description || ' (severity: ' || severity || ')', '|' "
    "ORDER BY line_number, test_id) AS issues FROM kept GROUP BY function_id",
)
def scan_gate(spark, sf_dir):
    flagged = P.flagged_only(_results(spark, sf_dir)).select("function_id", "bandit_enabled")
    kept = S.gate_issues(S.security_issues(B.scan_reports(spark, sf_dir)), flagged)
    lists = S.issue_lists(kept)
    return lists.select("function_id", F.array_join("security_issues", "|").alias("issues"))


# --- triage -----------------------------------------------------------------------

# The expected texts are written out here, so that a changed one shows.
_PROMPT_SQL = _quoted("""You triage a pull request for production risk only.

Answer severity=none for style, complexity or readability concerns, and
whenever you are not sure that there is a real defect.
Answer severity=high or severity=critical only for a security hole, a crash on
realistic input, lost or corrupted data, a concurrency defect, or code whose
result is wrong in production.

The complexity score (@score@) only selected this function for review and is
no reason to flag it.

The @language@ function `@function_name@`:

```@language@
<source>
```
""")
for _name in ("score", "language", "function_name"):
    _PROMPT_SQL = _PROMPT_SQL.replace(f"@{_name}@", f"' || {_name} || '")


@_register(
    "triage_prompt",
    _RESULTS + f" SELECT pr_number, function_name AS result_name, {_PROMPT_SQL} AS prompt FROM res WHERE is_flagged",
)
def triage_prompt(spark, sf_dir):
    prompted = L.with_prompts(P.flagged_only(_results(spark, sf_dir)))
    shown = F.replace(F.col("prompt"), F.col("source_code"), F.lit("<source>"))
    return prompted.select("pr_number", "result_name", shown.alias("prompt"))


@_register(
    "provider_resolution",
    _CODE + ", " + B.CONFIGS_CTE + ", asked AS (SELECT pr_number, "
    "CASE WHEN k % 10 = 9 THEN 'mystery' ELSE llm_provider END AS llm_provider, llm_model "
    "FROM code LEFT JOIN cfg USING (repo_full_name)) "
    "SELECT pr_number, coalesce(nullif(llm_provider, ''), 'proxy') AS provider, "
    "CASE WHEN llm_provider = 'mystery' THEN NULL ELSE coalesce(nullif(llm_model, ''), "
    "CASE coalesce(nullif(llm_provider, ''), 'proxy') WHEN 'openai' THEN 'gpt-4o' WHEN 'ollama' THEN 'codellama' "
    f"ELSE {_quoted(L.schemas.MODEL_DEFAULT)} END) END AS model, "
    "CASE WHEN llm_provider = 'mystery' THEN 'Unknown LLM provider: mystery' END AS provider_error FROM asked",
)
def provider_resolution(spark, sf_dir):
    prs = B.orders_code(spark, sf_dir).select("repo_full_name", "pr_number", "k")
    settled = G.with_run_config(prs, B.repo_configs(spark, sf_dir), F.col("pr_number"))
    asked = settled.withColumn(
        "llm_provider", F.when(F.col("k") % 10 == 9, "mystery").otherwise(F.col("llm_provider"))
    )
    return L.resolve_provider(asked).select("pr_number", "provider", "model", "provider_error")


@_register(
    "triage_validate",
    _CODE + ", " + B.TRIAGE_CTE + " SELECT function_id, result_name, is_valid FROM triage",
)
def triage_validate(spark, sf_dir):
    return L.validate_replies(B.triage_responses(spark, sf_dir)).select(
        "function_id", "result_name", "is_valid"
    )


@_register(
    "triage_validate_strict",
    _CODE + ", " + B.TRIAGE_CTE + " SELECT function_id, is_valid AND pr_number % 5 > 2 AS is_valid FROM triage",
)
def triage_validate_strict(spark, sf_dir):
    # A number and an object in place of a text, and text behind the reply.
    text, k = F.col("response_json"), F.col("pr_number") % 5
    summary = r'"summary":"[^"]*"'
    loose = (
        F.when(k == 0, F.regexp_replace(text, summary, '"summary":5'))
        .when(k == 1, F.regexp_replace(text, summary, '"summary":{"x":1}'))
        .when(k == 2, F.concat(text, F.lit(" and more"))).otherwise(text)
    )
    replies = B.triage_responses(spark, sf_dir, ("pr_number",)).withColumn("response_json", loose)
    return L.validate_replies(replies).select("function_id", "is_valid")


@_register(
    "severity_gate",
    _CODE + ", " + B.TRIAGE_CTE + " SELECT function_id, severity, issue_type, summary, suggested_fix, explanation "
    "FROM triage WHERE is_valid AND severity IN ('critical', 'high')",
)
def severity_gate(spark, sf_dir):
    replies = L.validate_replies(B.triage_responses(spark, sf_dir)).filter("is_valid")
    return L.severity_gate(replies).drop("result_name", "is_valid")


# --- configuration -----------------------------------------------------------------

_CONFIG_FIELDS = ("cc_threshold", "bandit_enabled", "llm_provider", "llm_model", "auto_post", "post_all_clear")


@_register(
    "config_join",
    _RESULTS + " SELECT DISTINCT repo_full_name, " + ", ".join(_CONFIG_FIELDS) + " FROM res",
)
def config_join(spark, sf_dir):
    # Only files that hold functions, as in a run.
    prs = B.orders_code(spark, sf_dir).filter(F.col("k") % 5 != 4).select("repo_full_name", "pr_number")
    settled = G.with_run_config(prs, B.repo_configs(spark, sf_dir), F.col("pr_number"))
    return settled.select("repo_full_name", *_CONFIG_FIELDS).distinct()


def _default_sql(field: str, value) -> str:
    text = "NULL" if value is None else str(value).upper() if isinstance(value, bool) else (
        _quoted(value) if isinstance(value, str) else str(value)
    )
    return text


@_register(
    "config_read",
    _CODE + ", " + B.CONFIGS_CTE + ", repos AS (SELECT DISTINCT repo_full_name FROM code) "
    "SELECT repo_full_name AS repo, "
    + ", ".join(
        f"CASE WHEN cfg.id IS NULL THEN {_default_sql(f, v)} ELSE cfg.{f} END AS {f}"
        for f, v in G.schemas.CONFIG_API_DEFAULTS.items()
    )
    + " FROM repos LEFT JOIN cfg USING (repo_full_name)",
)
def config_read(spark, sf_dir):
    repos = B.orders_code(spark, sf_dir).select("repo_full_name").distinct()
    return G.read_configs(repos, B.repo_configs(spark, sf_dir))


@_register(
    "config_upsert",
    "WITH " + B.CONFIGS_CTE + ", pat AS (SELECT 'org/r' || (o_custkey % 40) AS repo_full_name, "
    "max(o_orderkey) FILTER (o_orderkey % 3 = 0) AS k_thr, max(o_orderkey) FILTER (o_orderkey % 5 = 0) AS k_ban, "
    "max(o_orderkey) FILTER (o_custkey % 7 = 0) AS k_prov, max(o_orderkey) FILTER (o_orderkey % 7 = 0) AS k_post, "
    "max(o_orderkey) FILTER (o_orderkey % 11 = 0) AS k_exc FROM orders GROUP BY 1) "
    "SELECT coalesce(cfg.repo_full_name, pat.repo_full_name) AS repo_full_name, "
    "coalesce(k_thr % 20, CASE WHEN cfg.id IS NULL THEN 10 ELSE cfg.cc_threshold END)::INTEGER AS cc_threshold, "
    "coalesce(k_ban % 2 = 0, CASE WHEN cfg.id IS NULL THEN TRUE ELSE cfg.bandit_enabled END) AS bandit_enabled, "
    "CASE WHEN k_prov IS NOT NULL THEN 'ollama' WHEN cfg.id IS NULL THEN 'proxy' ELSE cfg.llm_provider END AS llm_provider, "
    f"CASE WHEN cfg.id IS NULL THEN {_quoted(L.schemas.MODEL_DEFAULT)} ELSE cfg.llm_model END AS llm_model, "
    "coalesce(k_post % 4 <> 0, CASE WHEN cfg.id IS NULL THEN TRUE ELSE cfg.auto_post END) AS auto_post, "
    "CASE WHEN cfg.id IS NULL THEN TRUE ELSE cfg.post_all_clear END AS post_all_clear, "
    "coalesce('gen/' || k_exc, CASE WHEN cfg.id IS NULL THEN '' ELSE cfg.exclude_patterns END) AS exclude_patterns "
    "FROM cfg FULL OUTER JOIN pat ON cfg.repo_full_name = pat.repo_full_name",
)
def config_upsert(spark, sf_dir):
    return G.upsert_configs(B.repo_configs(spark, sf_dir), B.config_patches(spark, sf_dir))


# --- the run --------------------------------------------------------------------------

_RUN = (
    _RESULTS + ", " + B.TRIAGE_CTE + ", joined AS (SELECT res.*, triage.is_valid, triage.severity, "
    "triage.issue_type, triage.summary, triage.suggested_fix, triage.explanation FROM res LEFT JOIN triage "
    "ON res.k = triage.k AND res.function_name = triage.result_name), "
    "per_pr AS (SELECT repo_full_name, pr_number, count(*) AS function_count, "
    "count(CASE WHEN is_flagged THEN 1 END) AS analyzed_count, "
    "count(CASE WHEN is_flagged AND is_valid AND severity IN ('critical', 'high') THEN 1 END) AS posted, "
    "count(CASE WHEN is_flagged AND NOT is_valid THEN 1 END) AS rejected, "
    "max(language) AS language FROM joined GROUP BY repo_full_name, pr_number)"
)

_OUTCOME = (
    _RUN + ", outcome AS (SELECT code.repo_full_name, code.pr_number, per_pr.language, "
    "coalesce(function_count, 0) AS function_count, coalesce(analyzed_count, 0) AS analyzed_count, "
    "CASE WHEN coalesce(rejected, 0) > 0 THEN 0 ELSE coalesce(posted, 0) END AS reviews_posted, "
    "CASE WHEN coalesce(rejected, 0) > 0 THEN 'failed' WHEN function_count IS NULL THEN 'no_functions' "
    "WHEN analyzed_count = 0 THEN 'nothing_to_scan' WHEN posted = 0 THEN 'all_clear' ELSE 'reviewed' END AS outcome, "
    "coalesce(CASE WHEN cfg.id IS NULL THEN TRUE ELSE cfg.auto_post AND cfg.post_all_clear END, FALSE) AS speaks "
    "FROM code LEFT JOIN per_pr USING (repo_full_name, pr_number) LEFT JOIN cfg USING (repo_full_name)), "
    "spoken AS (SELECT *, CASE WHEN speaks AND outcome IN ('no_functions', 'nothing_to_scan') THEN 'nothing_to_scan' "
    "WHEN speaks AND outcome = 'all_clear' THEN 'all_clear' END AS comment_kind FROM outcome)"
)


def _run(spark: SparkSession, sf_dir: str) -> P.ReviewRun:
    return P.review_run(
        B.diffs(spark, sf_dir),
        B.repo_configs(spark, sf_dir),
        B.triage_responses(spark, sf_dir),
        B.scan_reports(spark, sf_dir),
    )


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = P.scored_results(B.diffs(spark, sf_dir), B.repo_configs(spark, sf_dir), keep_all=True)
    replies = L.validate_replies(L.latest_replies(B.triage_responses(spark, sf_dir)))
    return P.pr_outcomes(P.pr_activity(results, replies))


@_register(
    "pr_counts",
    _RESULTS + " SELECT repo_full_name, pr_number, count(*) AS function_count, "
    "count(CASE WHEN is_flagged THEN 1 END) AS analyzed_count FROM res GROUP BY repo_full_name, pr_number",
)
def pr_counts(spark, sf_dir):
    return P.pr_counts(_results(spark, sf_dir))


@_register(
    "language_counts",
    _RESULTS + " SELECT repo_full_name, pr_number, language, count(*) AS n FROM res WHERE is_flagged "
    "GROUP BY repo_full_name, pr_number, language",
)
def language_counts(spark, sf_dir):
    return P.language_counts(_results(spark, sf_dir))


_FOOTER = _quoted(
    "\n---\n*revlake triages production risks only — style and complexity feedback is intentionally filtered out.*"
)
_COMMENT_SQL = (
    "'## ' || CASE severity WHEN 'critical' THEN '🚨' ELSE '🔴' END || "
    "' revlake — ' || CASE issue_type WHEN 'data_loss' THEN 'Data Loss' "
    "ELSE upper(issue_type[1]) || issue_type[2:] END || ' (' || upper(severity) || ')' || chr(10) || chr(10) || "
    "'**Function**: `' || function_name || '`' || chr(10) || chr(10) || '### What could go wrong' || chr(10) || summary "
    "|| chr(10) || chr(10) || '### Why' || chr(10) || explanation || chr(10) || "
    "CASE WHEN suggested_fix IS NULL THEN '' ELSE chr(10) || '### Suggested fix' || chr(10) || '```' || language "
    "|| chr(10) || suggested_fix || chr(10) || '```' || chr(10) END || "
    "CASE WHEN issues IS NULL THEN '' ELSE chr(10) || '### Static scanner flags' || chr(10) || issues END || "
    + _FOOTER
)
_REVIEW_SQL = (
    _RUN + ", " + B.REPORTS_CTE + ", lists AS (SELECT function_id, string_agg('- [' || test_id || '] ' || description || "
    "' (severity: ' || severity || ')' || chr(10), '' ORDER BY line_number, test_id) AS issues FROM issues GROUP BY function_id), "
    "posted AS (SELECT joined.*, CASE WHEN bandit_enabled THEN lists.issues END AS issues FROM joined "
    "LEFT JOIN lists ON lists.function_id = " + B.FUNCTION_ID_SQL.replace("sha256(", "sha256(joined.", 1)
    .replace("|| pr_number", "|| joined.pr_number") + " "
    "WHERE is_flagged AND is_valid AND severity IN ('critical', 'high')) "
)
_REVIEW_COLUMNS = (
    "repo_full_name", "pr_number", "pr_title", "function_name", "file_path", "line_number",
    "complexity_score", "priority", "status",
)


@_register(
    "review_rows",
    _REVIEW_SQL + "SELECT repo_full_name, pr_number, pr_title, function_name, file_path, start_line AS line_number, "
    "score::DOUBLE AS complexity_score, severity AS priority, "
    "CASE WHEN auto_post THEN 'posted' ELSE 'pending' END AS status FROM posted",
)
def review_rows(spark, sf_dir):
    return _run(spark, sf_dir).reviews.select(*_REVIEW_COLUMNS)


@_register(
    "review_comment",
    _REVIEW_SQL + f"SELECT pr_number, {_COMMENT_SQL} AS suggestion FROM posted",
)
def review_comment(spark, sf_dir):
    return _run(spark, sf_dir).reviews.select("pr_number", "suggestion")


@_register(
    "rollback_failed",
    _RUN + " SELECT repo_full_name, pr_number, " + _quoted(P.BAD_REPLY) + " AS error_message FROM per_pr WHERE rejected > 0",
)
def rollback_failed(spark, sf_dir):
    replies = L.validate_replies(B.triage_responses(spark, sf_dir))
    # Flagged results and diffs that don't parse come from one pass over the diffs.
    results = P.staged_results(B.diffs(spark, sf_dir), B.repo_configs(spark, sf_dir), keep_text=False)
    return P.failed_prs(P.flagged_only(results), replies, P.parse_failures(results))


@_register(
    "pr_outcome",
    _OUTCOME + " SELECT repo_full_name, pr_number, outcome, function_count, analyzed_count, reviews_posted, "
    "comment_kind, CASE WHEN outcome = 'failed' THEN 'failed' ELSE 'complete' END AS job_status FROM spoken",
)
def pr_outcome(spark, sf_dir):
    return _outcomes(spark, sf_dir).select(
        "repo_full_name", "pr_number", "outcome", "function_count", "analyzed_count", "reviews_posted",
        "comment_kind", "job_status",
    )


_WAITING = (
    _OUTCOME + ", late AS (SELECT spoken.*, (SELECT count(*) FROM joined WHERE joined.pr_number = spoken.pr_number "
    "AND is_flagged) > 0 AND pr_number % 7 = 1 AS waits FROM spoken) "
)


@_register(
    "pr_outcome_waiting",
    _WAITING + "SELECT pr_number, CASE WHEN waits THEN 'waiting' ELSE outcome END AS outcome, "
    "CASE WHEN waits THEN 0 ELSE reviews_posted END AS reviews_posted, CASE WHEN NOT waits THEN comment_kind END AS comment_kind, "
    "CASE WHEN waits THEN 'processing' WHEN outcome = 'failed' THEN 'failed' ELSE 'complete' END AS job_status FROM late",
)
def pr_outcome_waiting(spark, sf_dir):
    results = P.scored_results(B.diffs(spark, sf_dir), B.repo_configs(spark, sf_dir), keep_all=True)
    there = B.triage_responses(spark, sf_dir, ("pr_number",)).filter("pr_number % 7 <> 1").drop("pr_number")
    outcomes = P.pr_outcomes(P.pr_activity(results, L.validate_replies(L.latest_replies(there))))
    return outcomes.select("pr_number", "outcome", "reviews_posted", "comment_kind", "job_status")


@_register(
    "pr_outcome_repeated_replies",
    _OUTCOME + " SELECT pr_number, outcome, function_count, analyzed_count, reviews_posted FROM spoken",
)
def pr_outcome_repeated_replies(spark, sf_dir):
    # Every reply comes twice, and an earlier broken one with it.
    last = B.triage_responses(spark, sf_dir).withColumn("reply_seq", F.lit(2))
    first = last.withColumn("response_json", F.lit("{")).withColumn("reply_seq", F.lit(1))
    run = P.review_run(
        B.diffs(spark, sf_dir), B.repo_configs(spark, sf_dir), first.unionByName(last).unionByName(last),
        B.scan_reports(spark, sf_dir), staged=False,
    )
    return run.outcomes.select("pr_number", "outcome", "function_count", "analyzed_count", "reviews_posted")


@_register(
    "repeated_push",
    _OUTCOME + ", pushes AS (SELECT unnest(['push-1', 'push-2']) AS push) SELECT push || '-' || pr_number AS task_id, "
    "CASE WHEN push = 'push-2' AND outcome NOT IN ('no_functions', 'nothing_to_scan') THEN 'waiting' ELSE outcome END AS outcome, "
    "function_count, CASE WHEN push = 'push-2' THEN 0 ELSE reviews_posted END AS reviews, "
    "CASE WHEN push = 'push-2' THEN 0 ELSE reviews_posted END AS review_ids FROM spoken, pushes",
)
def repeated_push(spark, sf_dir):
    # Two pushes to every PR; only the first one's replies are there yet.
    diffs, configs = B.diffs(spark, sf_dir), B.repo_configs(spark, sf_dir)
    pushed = diffs.withColumn("_push", F.explode(F.array(F.lit("push-1"), F.lit("push-2")))).withColumn(
        "task_id", F.concat_ws("-", "_push", F.col("pr_number").cast("string"))
    ).drop("_push")
    results = P.staged_results(pushed, configs)
    first = results.filter(F.col("task_id").startswith("push-1")).select("function_id", "result_name", "pr_number")
    replies = B.triage_responses(spark, sf_dir, ("pr_number",)).drop("function_id").join(first, ["pr_number", "result_name"])
    run = P.run_of_results(results, replies.select("function_id", "result_name", "response_json"))
    posted = run.reviews.groupBy("task_id").agg(F.count("*").alias("reviews"), F.count_distinct("review_key").alias("review_ids"))
    found = run.outcomes.join(posted, "task_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("task_id", "outcome", "function_count", zero("reviews"), zero("review_ids"))


@_register(
    "deliveries_to_reviews",
    _FUNCTIONS + ", " + B.CONFIGS_CTE + ", " + B.DELIVERIES_CTE + ", runs AS (SELECT sha256(event_id::VARCHAR) AS task_id, event_id, repo_full_name, pr_number, pr_title, "
    "installation_id FROM sorted JOIN orders ON event_id = o_orderkey WHERE disposition = 'enqueued'), "
    "scored AS (SELECT runs.*, fns.function_name, fns.score > CASE WHEN cfg.id IS NULL THEN 10 ELSE cfg.cc_threshold END AS is_flagged "
    "FROM runs JOIN fns ON fns.k = runs.event_id LEFT JOIN cfg ON cfg.repo_full_name = runs.repo_full_name) "
    "SELECT runs.task_id, runs.repo_full_name, runs.pr_number, count(scored.function_name) AS function_count, "
    "count(CASE WHEN is_flagged THEN 1 END) AS reviews, max(CASE WHEN is_flagged THEN scored.pr_title END) AS pr_title, "
    "max(CASE WHEN is_flagged THEN scored.installation_id END) AS installation_id "
    "FROM runs LEFT JOIN scored USING (task_id) GROUP BY ALL",
)
def deliveries_to_reviews(spark, sf_dir):
    jobs = stage(W.jobs_from_deliveries(B.deliveries(spark, sf_dir), B.WEBHOOK_SECRET), "jobs")
    # The diff landed for a task is that of the order with the delivery's number.
    landed = B.diffs(spark, sf_dir).select(F.sha2(F.col("pr_number").cast("string"), 256).alias("task_id"), "diff_text")
    results = P.staged_results(P.diffs_of_jobs(jobs, landed), B.repo_configs(spark, sf_dir))
    replies = P.flagged_only(results).select("function_id", "result_name", F.lit(
        '{"severity":"high","issue_type":"crash","summary":"s","suggested_fix":null,"explanation":"e"}'
    ).alias("response_json"))
    run = P.run_of_results(results, replies)
    posted = run.reviews.groupBy("task_id").agg(F.count("*").alias("reviews"), F.max("pr_title").alias("pr_title"))
    installed = jobs.select(F.col("celery_task_id").alias("task_id"), "installation_id")
    made = run.outcomes.join(posted, "task_id", "left").join(installed, "task_id")
    return made.select(
        "task_id", "repo_full_name", "pr_number", "function_count", F.coalesce("reviews", F.lit(0)).alias("reviews"),
        "pr_title", F.when(F.col("reviews") > 0, F.col("installation_id")).alias("installation_id"),
    )


@_register(
    "diff_hostile_headers",
    _OUTCOME + " SELECT pr_number, CASE WHEN pr_number % 9 < 4 THEN 'failed' ELSE outcome END AS outcome, "
    "CASE WHEN pr_number % 9 < 4 THEN 0 ELSE function_count END AS function_count FROM spoken",
)
def diff_hostile_headers(spark, sf_dir):
    # Hunks that start or end behind the last number, claim billions of lines, or too few.
    k, text = F.col("pr_number") % 9, F.col("diff_text")
    header = r"@@ -(\d+),(\d+) \+(\d+),(\d+) @@"
    put = lambda new: F.regexp_replace(text, header, new)
    hostile = (
        F.when(k == 0, put("@@ -$1,$2 +2147483647,$4 @@")).when(k == 1, put("@@ -$1,$2 +$3,2147483000 @@"))
        .when(k == 2, put("@@ -$1,99999999999 +2147483647,2147483647 @@")).when(k == 3, put("@@ -$1,$2 +$3,1 @@"))
        .otherwise(text)
    )
    run = P.review_run(
        B.diffs(spark, sf_dir).withColumn("diff_text", hostile), B.repo_configs(spark, sf_dir),
        B.triage_responses(spark, sf_dir), B.scan_reports(spark, sf_dir), staged=False,
    )
    return run.outcomes.select("pr_number", "outcome", "function_count")


@_register(
    "run_summary",
    _OUTCOME + " SELECT pr_number, CASE outcome WHEN 'failed' THEN NULL WHEN 'no_functions' "
    "THEN 'No analyzable functions changed' ELSE 'Analyzed ' || function_count || ' functions' END AS message, "
    "reviews_posted FROM spoken",
)
def run_summary(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("pr_number", "message", "reviews_posted")


@_register(
    "all_clear_comment",
    _OUTCOME + " SELECT pr_number, "
    + _quoted("<!-- revlake:all-clear -->\n## ✓ revlake — No production risks found\n\n")
    + " || 'Reviewed ' || analyzed_count || CASE WHEN analyzed_count = 1 THEN ' function' ELSE ' functions' END "
    "|| ' (' || language || ': ' || analyzed_count || ')' || "
    + _quoted(
        ". All within acceptable complexity, no security / crash / data-loss / concurrency / correctness concerns "
        "flagged.\n\n---\n*revlake flags only production-risk findings; style and complexity feedback is intentionally "
        "filtered out. Disable per-repo in Settings if the acknowledgement is noise.*"
    )
    + " AS comment_body FROM spoken WHERE comment_kind = 'all_clear'",
)
def all_clear_comment(spark, sf_dir):
    outcomes = _outcomes(spark, sf_dir).filter(F.col("comment_kind") == "all_clear")
    return outcomes.select("pr_number", "comment_body")


@_register(
    "nothing_to_scan_comment",
    _OUTCOME + " SELECT pr_number, "
    + _quoted("<!-- revlake:nothing-to-scan -->\n## ⊘ revlake — Nothing to scan\n\n")
    + " || CASE WHEN function_count = 0 THEN " + _quoted(
        "No function-level changes were detected in this PR — the diff may contain only docs, config, assets, or "
        "unsupported file types. No analysis was run."
    )
    + " ELSE 'Found ' || function_count || ' changed ' || CASE WHEN function_count = 1 THEN 'function' ELSE 'functions' END || "
    + _quoted(", but none exceeded the complexity threshold for deeper review. No LLM triage was run.")
    + " END || " + _quoted(
        "\n\n---\n*revlake only scans functions that static analysis flags as sufficiently complex or risky. Adjust the "
        "per-repo complexity threshold in Settings if you'd like broader coverage.*"
    )
    + " AS comment_body FROM spoken WHERE comment_kind = 'nothing_to_scan'",
)
def nothing_to_scan_comment(spark, sf_dir):
    outcomes = _outcomes(spark, sf_dir).filter(F.col("comment_kind") == "nothing_to_scan")
    return outcomes.select("pr_number", "comment_body")


@_register(
    "notifications",
    _OUTCOME + " SELECT 'reviews_updates' AS key, '{\"event\":\"reviews_updated\",\"pr_number\":' || pr_number || '}' "
    "AS value FROM spoken WHERE outcome NOT IN ('no_functions', 'failed')",
)
def notifications(spark, sf_dir):
    return P.notifications(_outcomes(spark, sf_dir))


@_register(
    "comment_outbox",
    _OUTCOME + " SELECT 'review' AS kind, joined.pr_number, file_path AS path, start_line AS line FROM joined "
    "WHERE is_flagged AND is_valid AND severity IN ('critical', 'high') AND auto_post "
    "UNION ALL SELECT comment_kind, pr_number, NULL, NULL FROM spoken WHERE comment_kind IS NOT NULL",
)
def comment_outbox(spark, sf_dir):
    return _run(spark, sf_dir).outbox.select("kind", "pr_number", "path", "line")


# --- comments, commits, jobs ------------------------------------------------------------

_ACKNOWLEDGED = "CASE WHEN conv_id % 2 = 0 THEN 'all_clear' ELSE 'nothing_to_scan' END"


def _superseded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    comments = B.pr_comments(spark, sf_dir, C.STYLE.all_clear_marker, C.STYLE.nothing_to_scan_marker)
    prs = comments.select("repo_full_name", "pr_number").distinct()
    kind = F.when(F.col("pr_number") % 2 == 0, "all_clear").otherwise("nothing_to_scan")
    return comments, C.superseded_comments(comments, prs.withColumn("kind", kind))


_MARKED = (
    "WITH c AS (SELECT 'org/r' || (conv_id % 25) AS repo_full_name, conv_id AS pr_number, "
    "conv_id * 1000 + turn AS comment_id, turn <> 7 AND turn % 3 = conv_id % 2 AS superseded FROM conversations)"
)


@_register(
    "supersede_comments",
    _MARKED + " SELECT repo_full_name, pr_number, count(*) AS deleted FROM c WHERE superseded GROUP BY 1, 2",
)
def supersede_comments(spark, sf_dir):
    return C.deleted_counts(_superseded(spark, sf_dir)[1])


@_register("surviving_comments", _MARKED + " SELECT comment_id FROM c WHERE NOT superseded")
def surviving_comments(spark, sf_dir):
    return C.surviving_comments(*_superseded(spark, sf_dir)).select("comment_id")


@_register(
    "latest_commit",
    "SELECT pr_number, commit_sha FROM (SELECT l_orderkey AS pr_number, "
    "'c' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS commit_sha, row_number() OVER "
    "(PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS n "
    "FROM lineitem) WHERE n = 1",
)
def latest_commit(spark, sf_dir):
    return C.latest_commits(B.commits(spark, sf_dir)).select("pr_number", "commit_sha")


_JOB_STATUS = (
    "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' "
    "WHEN 'error' THEN 'failed' ELSE 'complete' END"
)


@_register(
    "job_current_status",
    f"SELECT user_id::VARCHAR AS task_id, arg_max({_JOB_STATUS}, (date_trunc('hour', ts), event_id)) AS status, "
    "arg_max(CASE WHEN event_type = 'error' THEN 'error ' || event_id ELSE '' END, "
    "(date_trunc('hour', ts), event_id)) AS error_message, count(*) AS events FROM events GROUP BY user_id",
)
def job_current_status(spark, sf_dir):
    return W.current_jobs(B.job_events(spark, sf_dir)).select(
        "task_id", "status", F.coalesce("error_message", F.lit("")).alias("error_message"), "events"
    )


# --- intake ---------------------------------------------------------------------------

_SORTED = "WITH " + B.DELIVERIES_CTE
_INNER, _OUTER = key_pads(B.WEBHOOK_SECRET)


@_register(
    "webhook_verify",
    "SELECT event_id::VARCHAR AS delivery_id, "
    "NOT (event_id % 37 = 0 OR event_id % 41 = 0 OR event_type = 'error') AS is_authentic FROM events",
)
def webhook_verify(spark, sf_dir):
    return W.verified(B.deliveries(spark, sf_dir), B.WEBHOOK_SECRET).select("delivery_id", "is_authentic")


@_register(
    "webhook_signature",
    "SELECT event_id::VARCHAR AS delivery_id, 'sha256=' || sha256(unhex("
    f"'{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(props)))) AS signature FROM events",
)
def webhook_signature(spark, sf_dir):
    events = B.table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").cast("string").alias("delivery_id"),
        sign_body(F.col("props"), B.WEBHOOK_SECRET).alias("signature"),
    )


@_register(
    "webhook_disposition",
    _SORTED + " SELECT CASE WHEN disposition <> 'unauthorized' AND event_id % 7 = 0 THEN 'malformed' ELSE disposition END "
    "AS disposition, count(*) AS deliveries FROM sorted GROUP BY ALL",
)
def webhook_disposition(spark, sf_dir):
    # Every seventh body goes on behind its JSON and is signed as it is.
    late = F.concat("body", F.lit(" and more"))
    rows = B.deliveries(spark, sf_dir).withColumn("_late", F.col("delivery_id").cast("long") % 7 == 0)
    rows = rows.withColumn("signature", F.when(
        F.col("_late") & signature_is_valid(F.col("body"), F.col("signature"), B.WEBHOOK_SECRET), sign_body(late, B.WEBHOOK_SECRET)
    ).otherwise(F.col("signature")))
    rows = rows.withColumn("body", F.when(F.col("_late"), late).otherwise(F.col("body"))).drop("_late")
    return W.disposition_counts(rows, B.WEBHOOK_SECRET)


_JOBS_SQL = (
    _SORTED + " SELECT sha256(event_id::VARCHAR) AS celery_task_id, repo_full_name, pr_number, pr_title, "
    "installation_id, 'queued' AS status FROM sorted WHERE disposition = 'enqueued'"
)
_JOB_COLUMNS = ("celery_task_id", "repo_full_name", "pr_number", "pr_title", "installation_id", "status")


@_register("webhook_jobs", _JOBS_SQL)
def webhook_jobs(spark, sf_dir):
    jobs = W.jobs_from_deliveries(B.deliveries(spark, sf_dir), B.WEBHOOK_SECRET)
    return jobs.select(*_JOB_COLUMNS)


@_register(
    "job_lookup",
    _SORTED + " SELECT sha256(event_id::VARCHAR) AS task_id, "
    "CASE WHEN disposition = 'enqueued' THEN 'queued' END AS status, "
    "CASE WHEN disposition = 'enqueued' THEN pr_number END AS pr_number FROM sorted",
)
def job_lookup(spark, sf_dir):
    events = B.table(spark, sf_dir, "events")
    tasks = events.select(F.sha2(F.col("event_id").cast("string"), 256).alias("task_id"))
    jobs = W.jobs_from_deliveries(B.deliveries(spark, sf_dir), B.WEBHOOK_SECRET)
    return W.jobs_by_task(jobs, tasks).select("task_id", "status", "pr_number")


@_register(
    "job_transitions",
    _OUTCOME + " SELECT 'task-' || pr_number AS task_id, seq, "
    "CASE WHEN seq = 1 THEN 'processing' WHEN outcome = 'failed' THEN 'failed' ELSE 'complete' END AS status, "
    "CASE WHEN seq = 2 AND outcome = 'failed' THEN " + _quoted(P.BAD_REPLY) + " END AS error_message "
    "FROM spoken, (SELECT unnest([1, 2])::BIGINT AS seq)",
)
def job_transitions(spark, sf_dir):
    jobs = B.orders_code(spark, sf_dir).select(
        F.format_string("task-%d", F.col("pr_number")).alias("celery_task_id"), "repo_full_name", "pr_number"
    )
    return P.job_transitions(_outcomes(spark, sf_dir), jobs).drop("ts")


# --- lists ----------------------------------------------------------------------------

_ISO = "strftime(created_at, '%Y-%m-%dT%H:%M:%S')"
_REVIEWS = "WITH " + B.REVIEWS_CTE
_REVIEW_VIEW = (
    "id, repo_full_name AS repo, pr_number, pr_title, function_name, file_path, line_number, "
    f"complexity_score::INTEGER AS complexity_score, suggestion, priority, status, {_ISO} AS created_at"
)
_NEWEST = "ORDER BY rev.created_at DESC NULLS LAST, id DESC"


@_register(
    "list_reviews",
    _REVIEWS + f" SELECT (SELECT count(*) FROM rev WHERE status = 'posted') AS total, {_REVIEW_VIEW} FROM rev "
    f"WHERE status = 'posted' {_NEWEST} LIMIT 50 OFFSET 10",
)
def list_reviews(spark, sf_dir):
    return Q.list_reviews(B.reviews(spark, sf_dir), status="posted", skip=10).with_total()


@_register(
    "list_reviews_after",
    _REVIEWS + f", page AS (SELECT * FROM rev WHERE status = 'posted' {_NEWEST} LIMIT 50 OFFSET 50) SELECT {_REVIEW_VIEW} FROM page",
)
def list_reviews_after(spark, sf_dir):
    # The second page starts behind the last row of the first, not at an offset.
    reviews = B.reviews(spark, sf_dir)
    last = Q.newest_first(reviews.filter("status = 'posted'")).offset(49).first()
    at = F.lit(last["created_at"]) if last["created_at"] else F.lit(None).cast("timestamp")
    return Q.list_reviews(reviews, status="posted", after=(at, last["id"])).rows


@_register(
    "list_reviews_empty_page",
    _REVIEWS + " SELECT count(*) AS total, NULL::BIGINT AS id, NULL::VARCHAR AS repo FROM rev WHERE repo_full_name = 'org/r7'",
)
def list_reviews_empty_page(spark, sf_dir):
    page = Q.list_reviews(B.reviews(spark, sf_dir), repo="org/r7", skip=10**6)
    return page.with_total().select("total", "id", "repo")


@_register(
    "stream_reviews_replayed",
    _REVIEWS + " SELECT repo_full_name, count(*) AS reviews, min(priority) AS priority FROM rev GROUP BY repo_full_name",
)
def stream_reviews_replayed(spark, sf_dir):
    path, reviews = new_folder(spark, "reviews"), B.reviews(spark, sf_dir)
    for part, batch in ((0, 0), (1, 1), (1, 1), (0, 0)):  # both batches come twice
        append_reviews(reviews.filter(F.col("id") % 2 == part), path, batch)
    stored = read_reviews(spark, path)
    return stored.groupBy("repo_full_name").agg(F.count("*").alias("reviews"), F.min("priority").alias("priority"))


@_register(
    "stream_update_events",
    _OUTCOME + " SELECT pr_number, count(*) AS updates FROM spoken WHERE outcome NOT IN ('no_functions', 'failed') GROUP BY pr_number",
)
def stream_update_events(spark, sf_dir):
    # Notifications of finished runs, among messages that announce something else.
    told = stage(P.notifications(_outcomes(spark, sf_dir)).select("value"), "told")
    other = told.select(F.regexp_replace("value", "reviews_updated", "ping").alias("value"))
    path = new_folder(spark, "messages")
    told.unionByName(other).write.json(path)
    events = T.update_events(spark.readStream.schema("value string").json(path))
    out, log = new_folder(spark, "updates"), new_folder(spark, "log")
    T.append_stream(events, out, log, available_now=True).awaitTermination()
    return spark.read.parquet(out).groupBy("pr_number").agg(F.count("*").alias("updates"))


@_register(
    "list_reviews_of_repo",
    _REVIEWS + " SELECT (SELECT count(*) FROM rev WHERE repo_full_name = 'org/r7') AS total, "
    f"{_REVIEW_VIEW} FROM rev WHERE repo_full_name = 'org/r7' {_NEWEST} LIMIT 100",
)
def list_reviews_of_repo(spark, sf_dir):
    return Q.list_reviews(B.reviews(spark, sf_dir), repo="org/r7", limit=100).with_total()


@_register("get_review", _REVIEWS + f" SELECT {_REVIEW_VIEW} FROM rev WHERE id = 77")
def get_review(spark, sf_dir):
    return Q.get_review(B.reviews(spark, sf_dir), 77)


@_register(
    "list_jobs",
    _SORTED + ", j AS (SELECT *, ts AS created_at, sha256(event_id::VARCHAR) AS celery_task_id FROM sorted "
    "WHERE disposition = 'enqueued' AND repo_full_name = 'org/r3') "
    "SELECT (SELECT count(*) FROM j) AS total, celery_task_id, repo_full_name AS repo, pr_number, "
    "'queued' AS status, NULL::VARCHAR AS error_message, "
    "CASE WHEN microsecond(created_at) % 1000000 = 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') END AS created_at FROM j ORDER BY j.created_at DESC LIMIT 20",
)
def list_jobs(spark, sf_dir):
    jobs = W.jobs_from_deliveries(B.deliveries(spark, sf_dir), B.WEBHOOK_SECRET)
    return Q.list_jobs(jobs, repo="org/r3", status="queued").with_total().drop("id")


# --- analytics --------------------------------------------------------------------------

_AVG = "floor(sum(coalesce(complexity_score, 0)) / count(*) * 10 + 0.5) / 10"
_BUCKET = "upper(priority[1]) || lower(priority[2:])"


def _stats_sql(source: str, high: str) -> str:
    return (
        f"SELECT count(*) AS total_reviews, printf('%.1f', {_AVG}) AS avg_complexity, "
        f"count(CASE WHEN {high} THEN 1 END) AS high_priority, "
        f"count(CASE WHEN status = 'posted' THEN 1 END) AS posted FROM {source}"
    )


@_register("dashboard_stats", _REVIEWS + " " + _stats_sql("rev", f"{_BUCKET} = 'High'"))
def dashboard_stats(spark, sf_dir):
    return A.dashboard_stats(B.reviews(spark, sf_dir))


@_register(
    "dashboard_stats_newest",
    _REVIEWS + f", page AS (SELECT * FROM rev {_NEWEST} LIMIT 100) " + _stats_sql("page", "priority = 'High'"),
)
def dashboard_stats_newest(spark, sf_dir):
    return A.dashboard_stats(B.reviews(spark, sf_dir), newest=A.ANALYTICS_NEWEST, exact_case=True)


@_register(
    "priority_breakdown",
    _REVIEWS + ", buckets AS (SELECT unnest(['Critical', 'High', 'Medium', 'Low']) AS priority), "
    f"counted AS (SELECT {_BUCKET} AS priority, count(*) AS n FROM rev GROUP BY 1) "
    "SELECT buckets.priority, coalesce(n, 0) AS reviews, "
    "floor(100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM rev) + 0.5)::BIGINT AS percent "
    "FROM buckets LEFT JOIN counted USING (priority)",
)
def priority_breakdown(spark, sf_dir):
    return A.priority_breakdown(B.reviews(spark, sf_dir))


@_register(
    "complexity_trend",
    _REVIEWS + " SELECT coalesce(strftime(created_at, '%Y-%m-%d'), 'unknown') AS date, count(*) AS reviews, "
    f"{_AVG} AS avg_complexity FROM rev GROUP BY 1",
)
def complexity_trend(spark, sf_dir):
    return A.complexity_trend(B.reviews(spark, sf_dir))


@_register(
    "top_files",
    _REVIEWS + " SELECT coalesce(regexp_extract(file_path, '[^/]+$'), 'unknown') AS file, count(*) AS reviews "
    "FROM rev GROUP BY 1 ORDER BY reviews DESC, file LIMIT 10",
)
def top_files(spark, sf_dir):
    return A.top_files(B.reviews(spark, sf_dir))


@_register(
    "activity_heatmap",
    _REVIEWS + " SELECT (dayofweek(created_at) + 1)::INTEGER AS weekday, hour(created_at)::INTEGER AS hour, count(*) AS reviews "
    "FROM rev WHERE created_at IS NOT NULL GROUP BY 1, 2",
)
def activity_heatmap(spark, sf_dir):
    return A.activity_heatmap(B.reviews(spark, sf_dir))


@_register(
    "pr_cards",
    _REVIEWS + ", last AS (SELECT *, row_number() OVER (PARTITION BY repo_full_name, pr_number "
    "ORDER BY created_at DESC NULLS LAST, id DESC) AS n, count(*) OVER (PARTITION BY repo_full_name, pr_number) AS flagged, "
    "max(complexity_score) OVER (PARTITION BY repo_full_name, pr_number) AS top FROM rev) "
    "SELECT repo_full_name, pr_number, pr_title, flagged AS flagged_functions, top AS top_complexity, status "
    "FROM last WHERE n = 1",
)
def pr_cards(spark, sf_dir):
    return A.pr_cards(B.reviews(spark, sf_dir))


@_register(
    "feed_rows",
    _REVIEWS + " SELECT id, repo_full_name AS repo, pr_number, coalesce(nullif(function_name, ''), pr_title) AS title, "
    "coalesce(file_path, '') || CASE WHEN line_number <> 0 THEN ':' || line_number ELSE '' END AS place, "
    "CASE WHEN priority IN ('High', 'Medium', 'Low') THEN priority ELSE 'Low' END AS priority_class, "
    "CASE status WHEN 'posted' THEN 'check' WHEN 'error' THEN 'alert' ELSE 'clock' END AS status_icon "
    f"FROM rev {_NEWEST} LIMIT 50",
)
def feed_rows(spark, sf_dir):
    return A.feed_rows(B.reviews(spark, sf_dir))


@_register(
    "job_activity",
    "WITH latest AS (SELECT user_id, arg_max(" + _JOB_STATUS + ", (date_trunc('hour', ts), event_id)) AS status "
    "FROM events GROUP BY user_id) SELECT status AS job_class, count(*) AS jobs FROM latest GROUP BY status",
)
def job_activity(spark, sf_dir):
    current = W.current_jobs(B.job_events(spark, sf_dir))
    return current.groupBy(A.job_class(F.col("status")).alias("job_class")).agg(F.count("*").alias("jobs"))


# --- streams ----------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = B.table(spark, sf_dir, "events").schema
    # A file source reads folders, so the table's file is named by a pattern.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


@_register("stream_webhook_jobs", _JOBS_SQL)
def stream_webhook_jobs(spark, sf_dir):
    folder = new_folder(spark, "stream-jobs")
    jobs = T.job_stream(B.delivery_rows(_event_stream(spark, sf_dir)), B.WEBHOOK_SECRET)
    T.append_stream(
        jobs.select(*_JOB_COLUMNS), f"{folder}/out", f"{folder}/state", available_now=True
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@_register(
    "stream_notifications",
    "SELECT 'reviews_updates' AS key, '{\"event\":\"reviews_updated\",\"pr_number\":' || user_id || '}' AS value "
    "FROM events WHERE event_type = 'purchase'",
)
def stream_notifications(spark, sf_dir):
    folder = new_folder(spark, "stream-notifications")
    finished = _event_stream(spark, sf_dir).filter(F.col("event_type") == "purchase")
    messages = T.notification_stream(finished.select(F.col("user_id").alias("pr_number")))
    T.append_stream(messages, f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@_register(
    "stream_status_counts",
    f"SELECT {_JOB_STATUS} AS status, count(*) AS n FROM events GROUP BY 1",
)
def stream_status_counts(spark, sf_dir):
    folder = new_folder(spark, "stream-status")
    status = F.expr(_JOB_STATUS)
    counts = T.status_counts(_event_stream(spark, sf_dir).select(status.alias("status")), "status")
    T.versioned_stream(counts, f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    return latest_version(spark.read.parquet(f"{folder}/out"))

