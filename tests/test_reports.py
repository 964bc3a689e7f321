import json

import pytest
from pyspark.sql import functions as F

from revlake.functions.rules import SOURCE_RULES, rule_issues
from revlake.operators import security as S


def reports(spark, *rows):
    return spark.createDataFrame(list(rows), "function_id string, tool string, stdout string")


def issues(spark, tool, stdout):
    rows = S.security_issues(reports(spark, ("f", tool, stdout))).collect()
    return [(r.test_id, r.description, r.severity, r.confidence, r.line_number) for r in rows]


def test_bandit_defaults(spark):
    out = json.dumps({"results": [
        {"test_id": "B101", "issue_text": "assert", "issue_severity": "HIGH", "issue_confidence": "HIGH", "line_number": 4},
        {"issue_text": "bare"},
    ]})
    assert issues(spark, "bandit", out) == [("B101", "assert", "HIGH", "HIGH", 4), ("", "bare", "LOW", "LOW", 0)]


def test_gosec_line_ranges(spark):
    out = json.dumps({"Issues": [
        {"rule_id": "G1", "details": "d", "severity": "HIGH", "confidence": "LOW", "line": "7"},
        {"rule_id": "G2", "details": "e", "line": "42-45"},
        {"line": 9},
    ]})
    assert issues(spark, "gosec", out) == [
        ("G1", "d", "HIGH", "LOW", 7), ("G2", "e", "LOW", "LOW", 0), ("", "", "LOW", "LOW", 9),
    ]


def test_eslint_security_rules_only(spark):
    out = json.dumps([
        {"messages": [
            {"ruleId": "security/detect-x", "severity": 2, "message": "m", "line": 3},
            {"ruleId": "semi", "severity": 2, "message": "n", "line": 4},
            {"ruleId": None, "message": "fatal"},
            {"ruleId": "security/detect-y", "severity": 1},
        ]},
        {"filePath": "no messages"},
    ])
    assert issues(spark, "eslint_security", out) == [
        ("security/detect-x", "m", "HIGH", "MEDIUM", 3), ("security/detect-y", "", "MEDIUM", "MEDIUM", 0),
    ]


def test_clippy_lines(spark):
    def line(code, level, spans, reason="compiler-message"):
        return json.dumps({"reason": reason, "message": {
            "code": {"code": code} if code else None, "level": level, "message": "m", "spans": spans}})

    out = "\n".join([
        line("clippy::a", "error", [{"line_start": 5}, {"line_start": 9}]),
        "not json", "",
        line("clippy::b", "warning", []),
        line("dead_code", "warning", []),
        line(None, "error", []),
        line("clippy::c", "error", [], reason="build-finished"),
    ])
    assert issues(spark, "clippy", out) == [
        ("clippy::a", "m", "HIGH", "MEDIUM", 5), ("clippy::b", "m", "MEDIUM", "MEDIUM", 0),
    ]


@pytest.mark.parametrize("tool", ["bandit", "gosec", "eslint_security", "clippy", "unheard-of"])
@pytest.mark.parametrize("stdout", ["", None, "{broken", "[]", "{}", "null"])
def test_unreadable_reports_give_no_issues(spark, tool, stdout):
    assert issues(spark, tool, stdout) == []


def test_dispatch_by_language(spark):
    rows = reports(spark, ("f", "bandit", '{"results":[{"test_id":"B1"}]}'), ("g", "gosec", '{"Issues":[{"rule_id":"G1"}]}'))
    assert [r.test_id for r in S.bandit_scan(rows).collect()] == ["B1"]
    assert [r.test_id for r in S.issues_by_language(rows, "go").collect()] == ["G1"]
    assert S.issues_by_language(rows, "cobol").count() == 0


def test_report_health(spark):
    rows = reports(spark, ("f", "bandit", "{broken"), ("g", "bandit", "{}"), ("h", "bandit", ""), ("i", "clippy", "x"))
    health = {r.tool: (r.reports, r.unreadable) for r in S.report_health(rows).collect()}
    assert health == {"bandit": (3, 1), "clippy": (1, 1)}


def test_complexity_reports(spark):
    go = "12 main Process a.go:3:1\nnoise\n 6 main (*S).Handle a.go:9:1  \nx main F a.go:1:1\n"
    js = json.dumps([{"messages": [
        {"ruleId": "complexity", "message": "Function 'f' has a complexity of 31. Maximum is 5."},
        {"ruleId": "complexity", "message": "Method 'm' has a complexity of 6."},
        {"ruleId": "complexity", "message": "Arrow function 'a' has a complexity of 21."},
        {"ruleId": "complexity", "message": "Arrow function has a complexity of 11."},
        {"ruleId": "complexity", "message": "no number"},
        {"ruleId": "semi", "message": "complexity of 3"},
    ]}])
    rows = S.complexity_reports(reports(spark, ("g", "gocyclo", go), ("j", "eslint_complexity", js)), 10).collect()
    assert [(r.function_id, r.result_name, r.score, r.rank, r.is_flagged) for r in rows] == [
        ("g", "Process", 12, "C", True), ("g", "(*S).Handle", 6, "B", False),
        ("j", "f", 31, "F", True), ("j", "m", 6, "B", False), ("j", "a", 21, "D", True),
        ("j", "anonymous", 11, "C", True),
    ]


def test_source_rules(spark):
    texts = [
        ("javascript", "const a = 1;\neval(userInput);\nnew RegExp(x); child_process.exec(y)"),
        ("python", "x = 1\npassword = 'hunter22'\nvalue = eval(data)"),
        ("go", "eval(x)"),
        ("python", ""),
    ]
    df = spark.createDataFrame(texts, "l string, t string")
    found = df.select(F.col("l"), rule_issues(F.col("t"), F.col("l"), SOURCE_RULES).alias("i")).collect()
    assert [[(i.test_id, i.line_number) for i in r.i] for r in found] == [
        [("security/detect-eval-with-expression", 2), ("security/detect-non-literal-regexp", 3),
         ("security/detect-child-process", 3)],
        [("hardcoded-secret", 2), ("eval-call", 3)],
        [], [],
    ]


def test_gate_and_issue_lists(spark):
    rows = reports(
        spark,
        ("a", "bandit", '{"results":[{"test_id":"B2","line_number":9},{"test_id":"B1","issue_text":"t","line_number":2}]}'),
        ("b", "bandit", '{"results":[{"test_id":"B3"}]}'),
        ("c", "bandit", '{"results":[{"test_id":"B4"}]}'),
    )
    flagged = spark.createDataFrame(
        [("a", True), ("a", True), ("b", False), ("d", True)], "function_id string, bandit_enabled boolean"
    )
    lists = S.issue_lists(S.gate_issues(S.security_issues(rows), flagged)).collect()
    assert [(r.function_id, r.security_issues) for r in lists] == [
        ("a", ["[B1] t (severity: LOW)", "[B2]  (severity: LOW)"])
    ]


def test_json_of_any_depth(spark):
    from revlake.functions.strict_json import is_json

    deep = lambda n, inner: "[" * n + inner + "]" * n
    texts = {deep(n, '{"a": 1, "a": 2}'): True for n in (0, 5, 31, 32, 200)}
    texts |= {deep(200, '{"a": 1, "a": 2') : False, deep(200, '{"a": 1, "a": 2}')[:-1]: False, "[" * 3000 + "]" * 2999: False, "[{}, {}, []]" * 2: False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", is_json(F.col("t")).alias("j")).collect()
    assert {r.t: r.j for r in rows} == texts


def test_rules_of_a_table(spark):
    from revlake.operators import security as S

    rules = [
        ("eval", None, "eval(", r"\beval\(", "LOW", "HIGH", "d"), ("js", "javascript", "new Buffer", r"new\s+Buffer\(", "HIGH", "LOW", "d"),
        ("é", None, "é€x", "é€x+", "LOW", "LOW", "d"), ("never", None, "zzz", ".", "LOW", "LOW", "d"),
    ]
    index = S.rule_index(spark.createDataFrame(rules, "rule_id string, language string, needle string, pattern string, severity string, confidence string, description string"))
    texts = [(1, "a\nx = eval(b)\nmy_eval(c)\neval(d)", "python"), (2, "new Buffer(1)", "javascript"), (3, "new Buffer(1)", "python"), (4, "é€xx", None), (5, None, "go"), (6, "", "go"), (7, "ev", "go")]
    found = S.scan_with_rule_table(spark.createDataFrame(texts, "k long, t string, lang string"), "k", "t", "lang", index)
    assert sorted((r.k, r.test_id, r.line_number) for r in found.collect()) == [(1, "eval", 2), (1, "eval", 4), (2, "js", 1), (4, "é", 1)]
