"""Scanner and complexity-tool reports as arrays of normalised results.

A report is one string per row and is opened inside its row. A report that
cannot be read gives an empty array, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlake import schemas
from revlake.functions.strict_json import is_json
from revlake.languages import LANGUAGES

ISSUE_TYPE = (
    "array<struct<test_id:string,description:string,severity:string,confidence:string,line_number:int>>"
)
RESULT_TYPE = "array<struct<result_name:string,score:int>>"

# The tools' line and message formats.
GOCYCLO_LINE = r"^\s*(\d+)\s+\S+\s+(\S+)\s+\S+:\d+:\d+\s*$"
ESLINT_SCORE = r"complexity of (\d+)"
ESLINT_NAME = r"(?:Function|Method|Arrow function) '([^']+)'"
SECURITY_PREFIX = "security/"
CLIPPY_PREFIX = "clippy::"


def _or(value: Column, default: str | int) -> Column:
    return F.coalesce(value, F.lit(default))


def _issue(test_id, description, severity, confidence, line_number) -> Column:
    return F.struct(
        test_id.alias("test_id"),
        description.alias("description"),
        severity.alias("severity"),
        confidence.alias("confidence"),
        line_number.cast("int").alias("line_number"),
    )


def _opened(stdout: Column, schema) -> Column:
    """A report that is one JSON text as a whole, else null."""
    return F.from_json(F.when(is_json(stdout), stdout), schema)


def is_readable(tool: Column, stdout: Column) -> Column:
    """Whether a tool's report can be read; an empty one can.

    Reports by line are readable when one line is.
    """
    lines = F.split(stdout, "\n", -1)
    return (
        F.when(stdout == "", True)
        .when(tool == "clippy", F.exists(lines, is_json))
        .when(tool == "gocyclo", F.exists(lines, lambda l: l.rlike(GOCYCLO_LINE)))
        .otherwise(is_json(stdout))
    )


def bandit_issues(stdout: Column) -> Column:
    items = _opened(stdout, schemas.BANDIT_REPORT)["results"]
    return F.transform(
        items,
        lambda i: _issue(
            _or(i["test_id"], ""), _or(i["issue_text"], ""), _or(i["issue_severity"], "LOW"),
            _or(i["issue_confidence"], "LOW"), _or(i["line_number"], 0),
        ),
    )


def gosec_issues(stdout: Column) -> Column:
    items = _opened(stdout, schemas.GOSEC_REPORT)["Issues"]
    return F.transform(
        items,
        lambda i: _issue(
            _or(i["rule_id"], ""), _or(i["details"], ""), _or(i["severity"], "LOW"),
            _or(i["confidence"], "LOW"), _or(i["line"].try_cast("int"), 0),
        ),
    )


def _eslint_messages(stdout: Column) -> Column:
    files = _opened(stdout, schemas.ESLINT_REPORT)
    nothing = F.array().cast(schemas.ESLINT_REPORT.elementType["messages"].dataType)
    return F.flatten(F.transform(files, lambda f: F.coalesce(f["messages"], nothing)))


def eslint_security_issues(stdout: Column) -> Column:
    kept = F.filter(
        _eslint_messages(stdout), lambda m: _or(m["ruleId"], "").startswith(SECURITY_PREFIX)
    )
    return F.transform(
        kept,
        lambda m: _issue(
            m["ruleId"], _or(m["message"], ""), F.when(m["severity"] == 2, "HIGH").otherwise("MEDIUM"),
            F.lit("MEDIUM"), _or(m["line"], 0),
        ),
    )


def clippy_issues(stdout: Column) -> Column:
    lines = F.transform(F.split(stdout, "\n", -1), lambda l: _opened(l, schemas.CLIPPY_LINE))
    kept = F.filter(
        lines,
        lambda l: _or(l["reason"], "").eqNullSafe("compiler-message")
        & _or(l["message"]["code"]["code"], "").startswith(CLIPPY_PREFIX),
    )
    return F.transform(
        kept,
        lambda l: _issue(
            l["message"]["code"]["code"],
            _or(l["message"]["message"], ""),
            F.when(l["message"]["level"] == "error", "HIGH").otherwise("MEDIUM"),
            F.lit("MEDIUM"),
            _or(F.get(l["message"]["spans"], F.lit(0))["line_start"], 0),
        ),
    )


def gocyclo_results(stdout: Column) -> Column:
    rows = F.filter(F.split(stdout, "\n", -1), lambda l: l.rlike(GOCYCLO_LINE))
    return F.transform(
        rows,
        lambda l: F.struct(
            F.regexp_extract(l, GOCYCLO_LINE, 2).alias("result_name"),
            F.regexp_extract(l, GOCYCLO_LINE, 1).try_cast("int").alias("score"),
        ),
    )


def eslint_complexity_results(stdout: Column) -> Column:
    kept = F.filter(
        _eslint_messages(stdout),
        lambda m: (_or(m["ruleId"], "") == "complexity") & _or(m["message"], "").rlike(ESLINT_SCORE),
    )
    return F.transform(
        kept,
        lambda m: F.struct(
            F.coalesce(
                F.nullif(F.regexp_extract(m["message"], ESLINT_NAME, 1), F.lit("")), F.lit("anonymous")
            ).alias("result_name"),
            F.regexp_extract(m["message"], ESLINT_SCORE, 1).try_cast("int").alias("score"),
        ),
    )


# Security tools by name, and the tool that serves each language.
SECURITY_TOOLS: dict[str, Callable[[Column], Column]] = {
    "bandit": bandit_issues,
    "eslint_security": eslint_security_issues,
    "clippy": clippy_issues,
    "gosec": gosec_issues,
}
COMPLEXITY_TOOLS: dict[str, Callable[[Column], Column]] = {
    "gocyclo": gocyclo_results,
    "eslint_complexity": eslint_complexity_results,
}
SECURITY_TOOL_OF = {spec.language: spec.security_tool for spec in LANGUAGES if spec.security_tool}


def by_tool(
    tool: Column, stdout: Column, tools: dict[str, Callable[[Column], Column]], empty: str
) -> Column:
    """Dispatch on the tool; an unknown tool or unreadable report gives no results."""
    choice = None
    for name, parse in tools.items():
        test, value = tool == name, parse(stdout).cast(empty)
        choice = F.when(test, value) if choice is None else choice.when(test, value)
    return F.coalesce(choice, F.array().cast(empty))
