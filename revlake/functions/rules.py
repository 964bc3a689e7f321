"""Source rules matched line by line inside a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlake.functions.reports import ISSUE_TYPE

_START = r"(?:^|[^A-Za-z0-9_])"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    severity: str
    confidence: str
    description: str
    language: str | None = None  # None applies to every language


HARDCODED_SECRET = Rule(
    "hardcoded-secret",
    "(?i)" + _START + r"(?:token|secret|password|passwd|api_?key)\s*[:=]\s*[\"'][^\"']{6,}[\"']",
    "LOW", "MEDIUM", "Possible hardcoded secret",
)
PYTHON_EVAL = Rule(
    "eval-call", _START + r"(?:eval|exec)\s*\(", "MEDIUM", "HIGH",
    "Use of eval or exec on a value", "python",
)

# Rules for what the scanners of each language are asked to report.
SOURCE_RULES: tuple[Rule, ...] = (
    HARDCODED_SECRET,
    PYTHON_EVAL,
    Rule("security/detect-eval-with-expression", _START + r"eval\s*\(\s*[^\"'`\s)]", "HIGH", "MEDIUM",
         "eval with an expression", "javascript"),
    Rule("security/detect-non-literal-regexp", r"new\s+RegExp\s*\(\s*[^\"'`/\s)]", "HIGH", "MEDIUM",
         "Regular expression built from a value", "javascript"),
    Rule("security/detect-unsafe-regex", r"\([^()]*[+*][^()]*\)[+*]", "HIGH", "MEDIUM",
         "Nested repeats in a regular expression", "javascript"),
    Rule("security/detect-pseudoRandomBytes", r"pseudoRandomBytes", "HIGH", "MEDIUM",
         "Predictable random bytes", "javascript"),
    Rule("security/detect-new-buffer", r"new\s+Buffer\s*\(", "HIGH", "MEDIUM",
         "Buffer constructor call", "javascript"),
    Rule("security/detect-child-process", r"child_process", "HIGH", "MEDIUM",
         "Use of child processes", "javascript"),
    Rule("security/detect-object-injection", r"[A-Za-z0-9_$]\[\s*[A-Za-z_$][A-Za-z0-9_$]*\s*\]",
         "MEDIUM", "MEDIUM", "Property access by a variable", "javascript"),
)


def _applies(rule: Rule, language: Column | None, line: Column) -> Column:
    hit = line.rlike(rule.pattern)
    if rule.language is None or language is None:
        return hit
    return (language == rule.language) & hit


def rule_issues(text: Column, language: Column | None = None, rules: tuple[Rule, ...] = SOURCE_RULES) -> Column:
    """Issues of a text, in line order.

    Rules are literals, so each pattern is compiled once per task; the lines
    are only visited when some rule matches somewhere in the text.
    """

    def of_line(line: Column, index: Column) -> Column:
        return F.filter(
            F.array(
                *[
                    F.when(
                        _applies(rule, language, line),
                        F.struct(
                            F.lit(rule.rule_id).alias("test_id"),
                            F.lit(rule.description).alias("description"),
                            F.lit(rule.severity).alias("severity"),
                            F.lit(rule.confidence).alias("confidence"),
                            (index + 1).alias("line_number"),
                        ),
                    )
                    for rule in rules
                ]
            ),
            lambda issue: issue.isNotNull(),
        )

    anywhere = F.lit(False)
    for rule in rules:
        pattern = rule.pattern.replace("(?:^|", "(?:(?m:^)|")
        hit = text.rlike(pattern)
        if rule.language is not None and language is not None:
            hit = (language == rule.language) & hit
        anywhere = anywhere | hit
    per_line = F.flatten(F.transform(F.split(text, "\n", -1), of_line))
    return F.when(anywhere, per_line.cast(ISSUE_TYPE)).otherwise(F.array().cast(ISSUE_TYPE))
