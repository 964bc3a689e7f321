"""Table and JSON schemas, and the column defaults applied when rows are made."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _I, _L, _D, _B, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)

DIFFS = _struct(repo_full_name=_S, pr_number=_L, pr_title=_S, diff_text=_S)

CHANGED_FUNCTIONS = _struct(
    repo_full_name=_S, pr_number=_L, file_path=_S, function_name=_S, source_code=_S,
    start_line=_I, end_line=_I, language=_S,
)

SCAN_REPORTS = _struct(function_id=_S, tool=_S, stdout=_S)

TRIAGE_RESPONSES = _struct(function_id=_S, result_name=_S, response_json=_S)

DELIVERIES = _struct(delivery_id=_S, received_at=_TS, signature=_S, body=_S)

JOBS = _struct(
    id=_L, celery_task_id=_S, repo_full_name=_S, pr_number=_L, status=_S, error_message=_S,
    created_at=_TS, updated_at=_TS, pr_title=_S, installation_id=_L,
)

JOB_EVENTS = _struct(task_id=_S, seq=_L, status=_S, error_message=_S, ts=_TS)

REPO_CONFIGS = _struct(
    id=_L, repo_full_name=_S, cc_threshold=_I, bandit_enabled=_B, llm_provider=_S, llm_model=_S,
    auto_post=_B, post_all_clear=_B, exclude_patterns=_S, created_at=_TS, updated_at=_TS,
)

REVIEWS = _struct(
    id=_L, repo_full_name=_S, pr_number=_L, pr_title=_S, function_name=_S, file_path=_S,
    line_number=_I, complexity_score=_D, suggestion=_S, priority=_S, status=_S, created_at=_TS,
    review_key=_S, task_id=_S,
)

PR_COMMENTS = _struct(repo_full_name=_S, pr_number=_L, comment_id=_L, body=_S, created_at=_TS)

# --- JSON documents -------------------------------------------------------

WEBHOOK_PAYLOAD = _struct(
    action=_S,
    pull_request=_struct(number=_L, title=_S),
    repository=_struct(full_name=_S),
    installation=_struct(id=_L),
)

TRIAGE_REPLY = _struct(severity=_S, issue_type=_S, summary=_S, suggested_fix=_S, explanation=_S)

BANDIT_REPORT = _struct(
    results=T.ArrayType(
        _struct(test_id=_S, issue_text=_S, issue_severity=_S, issue_confidence=_S, line_number=_I)
    )
)

GOSEC_REPORT = _struct(
    Issues=T.ArrayType(_struct(rule_id=_S, details=_S, severity=_S, confidence=_S, line=_S))
)

ESLINT_REPORT = T.ArrayType(
    _struct(messages=T.ArrayType(_struct(ruleId=_S, severity=_I, message=_S, line=_I)))
)

CLIPPY_LINE = _struct(
    reason=_S,
    message=_struct(
        code=_struct(code=_S), level=_S, message=_S, spans=T.ArrayType(_struct(line_start=_I))
    ),
)

# --- defaults -------------------------------------------------------------

# The stored column defaults and the two thresholds in use.
JOB_STATUS_DEFAULT = "queued"
REVIEW_DEFAULTS = {"priority": "Medium", "status": "pending"}
RUN_THRESHOLD_DEFAULT = 10
CONFIG_API_THRESHOLD_DEFAULT = 15
MODEL_DEFAULT = "anthropic/claude-sonnet-4-6"

# The default provider is a hosted proxy whose product name differs per site.
PROVIDER_DEFAULT = "proxy"

CONFIG_ROW_DEFAULTS = {
    "cc_threshold": RUN_THRESHOLD_DEFAULT,
    "bandit_enabled": True,
    "llm_provider": PROVIDER_DEFAULT,
    "llm_model": MODEL_DEFAULT,
    "auto_post": True,
    "post_all_clear": True,
    "exclude_patterns": "",
}
CONFIG_API_DEFAULTS = {**CONFIG_ROW_DEFAULTS, "cc_threshold": CONFIG_API_THRESHOLD_DEFAULT}

# What a run uses for a repository that has no configuration row.
RUN_CONFIG_DEFAULTS = {
    "cc_threshold": RUN_THRESHOLD_DEFAULT,
    "bandit_enabled": True,
    "llm_provider": None,
    "llm_model": None,
    "auto_post": True,
    "post_all_clear": True,
}
