import random

import pytest
from pyspark.sql import functions as F

from revlake.functions import lexing as X
from revlake.functions.lexing import match_arms
from revlake.languages import FLAGS, LANGUAGES
from revlake.operators import complexity as C


def results(spark, language, source, threshold):
    df = spark.createDataFrame([(language, source)], "language string, source_code string")
    rows = C.analyze_sources(df, threshold).orderBy("result_no").collect()
    return [(r.result_name, r.score, r.is_flagged) for r in rows]


def test_simple_function_is_not_flagged(spark):
    assert results(spark, "python", "def add(a, b):\n    return a + b\n", 10) == [("add", 1, False)]


def test_nested_branches_are_flagged(spark):
    text = "def deep(x):\n" + "".join("    " * (i + 1) + f"if x > {i}:\n" for i in range(10)) + "    " * 11 + "return x\n"
    assert results(spark, "python", text, 5) == [("deep", 11, True)]


def test_two_functions_keep_their_order(spark):
    text = (
        "def low(a):\n    return a\n\ndef high(a, b, c):\n    if a:\n        return 1\n"
        "    if b:\n        return 2\n    if c:\n        return 3\n    return 4\n"
    )
    assert results(spark, "python", text, 3) == [("low", 1, False), ("high", 4, True)]


@pytest.mark.parametrize("language,source", [("python", "def broken(\n    x"), ("cobol", "def f(): pass"), ("go", "")])
def test_no_results(spark, language, source):
    assert results(spark, language, source, 1) == []


@pytest.mark.parametrize(
    "language,source,score",
    [
        ("python", "def f(x):\n    # if a and b\n    s = 'for x in y'\n    return [i for i in x if i or s]", 4),
        ("python", "def f(x):\n    match x:\n        case 1:\n            pass\n        case _:\n            assert x", 4),
        ("javascript", "function f(a, b) {\n  return a ?? (b ? a?.c : 'x ? y' || 1);\n}", 4),
        ("javascript", "function f(a) {\n  switch (a) { case 1: break; case 2: break; }\n  try { } catch (e) { }\n}", 4),
        ("go", "func f(a int) {\n\tswitch a {\n\tcase 1:\n\tcase 2:\n\t}\n\tfor a > 0 && b || c { }\n}", 6),
        ("rust", "fn f(a: i32) {\n  if a { } else if b { } else { }\n  loop { while x { } }\n}", 5),
    ],
)
def test_branch_tokens(spark, language, source, score):
    assert results(spark, language, source, 100)[0][1] == score


def test_rust_lists_inner_functions(spark):
    text = "fn outer(a: i32) {\n  fn inner(b: i32) { if b > 0 { } }\n  if a > 0 { }\n}"
    assert results(spark, "rust", text, 2) == [("outer", 3, True), ("inner", 2, False)]


@pytest.mark.parametrize("spec", LANGUAGES, ids=lambda s: s.language)
def test_counts_over_code_equal_counts_over_blanked_text(spark, spec):
    pieces = [
        " if ", "for", " while(", "&&", "||", " ?? ", "?", "case x:", "\n", " match ", "{", "}", "=>", "loop ",
        "and", " or ", "# x if\n", "// if\n", "/* for */", '"if"', "'while'", "`for`", '"""if\n"""', "/", " x ", "\\", '"', "'",
    ]
    rng = random.Random(3)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    count = lambda code: sum(
        (F.regexp_count(code, F.lit(FLAGS + pattern)) for pattern, _ in spec.branch_rules), match_arms(code)
    )
    counted = df.select(
        "t", count(X.code_only(spec, F.col("t"))).alias("a"), count(X.blank_literals(spec, F.col("t"))).alias("b")
    )
    for row in counted.collect():
        assert row.a == row.b, repr(row.t)


def test_match_arms_count_per_enclosing_block(spark):
    def arms(text):
        return spark.range(1).select(match_arms(F.lit(text)).alias("n")).first().n

    assert arms("match a { 1 => 2, _ => 3 }") == 2
    assert arms("match a { 1 => match b { 2 => 3, _ => 4 }, _ => { f(|x| y); 5 } }") == 6
    assert arms("let f = x => y; match_it { a => b }") == 0
    assert arms("match a; { b => c }") == 0


def test_ranks(spark):
    scores = spark.createDataFrame([(s,) for s in (1, 5, 6, 10, 11, 20, 21, 30, 31, 40, 41)], "s int")
    rows = scores.select(
        C.rank_of(F.col("s")).alias("r"), C.rank_of(F.col("s"), F.lit("python")).alias("p")
    ).collect()
    assert "".join(r.r for r in rows) == "AABBCCDDFFF"
    assert "".join(r.p for r in rows) == "AABBCCDDEEF"


def test_go_package_clause(spark):
    def fixed(text):
        return spark.range(1).select(C.go_with_package(F.lit(text)).alias("s")).first().s

    assert fixed("func f() {}") == "package main\nfunc f() {}"
    assert fixed("\n package x\nfunc f() {}") == "\n package x\nfunc f() {}"
