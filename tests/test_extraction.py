import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from revlake.functions import lexing as X
from revlake.languages import GO, JAVASCRIPT, JS_RESERVED, LANGUAGES, PYTHON, RUST
from revlake.operators import extraction as E


def new_file(path, text):
    lines = text.strip("\n").split("\n")
    body = "\n".join("+" + line for line in lines)
    return (
        f"diff --git a/{path} b/{path}\nnew file mode 100644\n--- /dev/null\n+++ b/{path}\n"
        f"@@ -0,0 +1,{len(lines)} @@\n{body}\n"
    )


def diffs(spark, *texts):
    rows = [("org/a", n, "title", text) for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "repo_full_name string, pr_number long, pr_title string, diff_text string")


def functions(spark, path, text, **options):
    found = E.changed_functions(diffs(spark, new_file(path, text)), **options)
    return found.orderBy("start_line").collect()


PY = '''
class Cart:
    def total(self, items):
        for item in items:
            if item.active:

                yield item
    async def send(self): return 1
    def outer(self):
        def inner(x):
            return x
        return inner

def last(a,): pass
value = 1
'''


def test_python_bodies_follow_indentation(spark):
    rows = functions(spark, "cart.py", PY)
    assert [(r.function_name, r.start_line, r.end_line) for r in rows] == [
        ("total", 2, 6), ("send", 7, 7), ("outer", 8, 11), ("inner", 9, 10), ("last", 13, 13),
    ]
    assert rows[0].source_code.startswith("def total") and rows[0].source_code.endswith("yield item")
    assert {r.language for r in rows} == {"python"}


def test_file_first_line_mode(spark):
    rows = functions(spark, "cart.py", PY, line_mode="file_first")
    assert {r.start_line for r in rows} == {1}
    with pytest.raises(ValueError):
        functions(spark, "cart.py", PY, line_mode="other")


def test_javascript_forms(spark):
    text = """
function sum(items,
             start) {
  for (const i of items) {
    if (i.on) { start += i.price; }
  }
  const add = (x) => {
    return x;
  };
  return start;
}
const isEven = async (n) => {
  return `}${n}` + '{' // }
};
const inc = x => x + 1; const other = 2;
var plain = function named(a) { return a; }
async function fetchUser(id: number): Promise<User> {
  return api.get(`/u/${id}`);
}
class Box {
  open(a) {
    while (a) { a -= 1; }
  }
  if (x) {
  }
}
const half = (a) => a / 2
"""
    rows = functions(spark, "a.ts", text)
    assert [(r.function_name, r.start_line, r.end_line) for r in rows] == [
        ("sum", 1, 10), ("isEven", 11, 13), ("inc", 14, 14), ("plain", 15, 15), ("fetchUser", 16, 18),
        ("open", 20, 22), ("half", 26, 26),
    ]
    by_name = {r.function_name: r.source_code for r in rows}
    assert by_name["inc"] == "const inc = x => x + 1"
    assert by_name["half"] == "const half = (a) => a / 2"


def test_javascript_compat_takes_a_later_brace(spark):
    text = "const f = x => x + 1;\nfunction g() {\n  return 1;\n}\n"
    assert [r.function_name for r in functions(spark, "a.js", text)] == ["f", "g"]
    compat = functions(spark, "a.js", text, compat=True)
    assert [(r.function_name, r.end_line) for r in compat] == [("f", 4)]


def test_rust_forms(spark):
    text = """
trait T { fn forward(&self); }
fn declared(a: i32);
pub(crate) async fn fetch<T: Read>(url: &str) -> Result<T, E> {
    // } not here
    let s = "}";
    fn nested() { 1 }
}
pub const unsafe fn raw() { }
fn open() {
    if x {
"""
    rows = functions(spark, "m.rs", text)
    assert [(r.function_name, r.start_line, r.end_line) for r in rows] == [
        ("fetch", 3, 7), ("nested", 6, 6), ("raw", 8, 8),
    ]


def test_go_forms(spark):
    text = """
package main
func Process(r *Request) (*Response, error) {
\ts := `}` + "\\"}" /* } */
\treturn &Response{OK: true}, nil
}
func (s *Server) Handle(req *Request) error {
\treturn nil
}
func Open() {
\tif x {
"""
    rows = functions(spark, "m.go", text)
    assert [(r.function_name, r.start_line, r.end_line) for r in rows] == [
        ("Process", 2, 5), ("Handle", 6, 8), ("Open", 9, 10),
    ]


def test_mixed_diff_and_empty_diff(spark):
    mixed = new_file("README.md", "def fake(): pass") + new_file("m.py", "def real():\n    pass")
    found = E.changed_functions(diffs(spark, mixed, "", new_file("a.md", "# x"))).collect()
    assert [(r.pr_number, r.function_name, r.file_path) for r in found] == [(0, "real", "m.py")]


def test_keep_all_leaves_a_row_per_diff(spark):
    kept = E.changed_functions(
        diffs(spark, "", new_file("a.md", "x"), new_file("m.py", "x = 1"), new_file("m.py", "def f(): pass")),
        keep_all=True,
    ).collect()
    assert sorted((r.pr_number, r.function_name or "") for r in kept) == [(0, ""), (1, ""), (2, ""), (3, "f")]
    assert len({r.function_id for r in kept}) == 4


def test_lines_of_second_hunk(spark):
    text = (
        "--- a/m.go\n+++ b/m.go\n@@ -1 +1,2 @@\n keep\n+// note\n"
        "@@ -40,2 +41,5 @@\n a\n+func F() {\n+\tx()\n+}\n b\n"
    )
    (row,) = E.changed_functions(diffs(spark, text)).collect()
    assert (row.function_name, row.start_line, row.end_line) == ("F", 42, 44)


def test_bodies_wider_than_every_window(spark):
    inner = "\n".join(f"  const f{i} = (x) => {{ return x; }};" for i in range(300))
    text = f"function first() {{ }}\nfunction outer() {{\n{inner}\n}}\nfunction after() {{ return 1; }}"
    rows = functions(spark, "a.js", text)
    assert [(r.function_name, r.start_line, r.end_line) for r in rows] == [
        ("first", 1, 1), ("outer", 2, 303), ("after", 304, 304),
    ]
    rust = "fn outer() {\n" + "\n".join(f"  fn f{i}() {{ }}" for i in range(200)) + "\n}"
    assert len(functions(spark, "a.rs", rust)) == 201


def brute_force_end(text, language):
    """Length up to the closing brace of the first block, 0 if open, -1 if there is none."""
    depth, i, started = 0, 0, False
    if language == "go" or language == "javascript":
        i = text.find("{")
        if i < 0:
            return 0
    quotes = {"go": '"', "javascript": "'\"`", "rust": '"'}[language]
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if two == "//":
            end = text.find("\n", i)
            i = len(text) if end < 0 else end + 1
        elif two == "/*":
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
        elif language == "go" and c == "`":
            end = text.find("`", i + 1)
            i = len(text) if end < 0 else end + 1
        elif c in quotes:
            i += 1
            while i < len(text) and text[i] != c:
                i += 2 if text[i] == "\\" else 1
            i += 1
        else:
            if language == "rust" and c == ";" and not started:
                return -1
            if c == "{":
                depth, started = depth + 1, True
            elif c == "}" and started:
                depth -= 1
                if depth == 0:
                    return i + 1
            i += 1
    return 0


@pytest.mark.parametrize("spec", [GO, JAVASCRIPT, RUST], ids=lambda s: s.language)
def test_body_end_equals_brute_force(spark, spec):
    pieces = ["{", "}", "{", "}", '"', "'", "`", "//", "/*", "*/", "\n", "\\", "a", ";", " b ", "/", "*"]
    rng = random.Random(11)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    for row in df.select("t", X.body_end(spec, F.col("t")).alias("end")).collect():
        assert row.end == brute_force_end(row.t, spec.language), repr(row.t)


@pytest.mark.parametrize("spec", LANGUAGES, ids=lambda s: s.language)
def test_chunks_rebuild_the_text(spark, spec):
    pieces = [
        "def f(a):", "    def g(b): return 1", "function h(x) {", "  if (x) {", "}", "const k = y => y",
        "fn r<T>(t: T) {", "pub fn s(", "func (t *T) M() {", "", "  x = 1", "\t", "}", ") {",
    ]
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(1000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parts = F.regexp_extract_all("t", F.lit(X.chunk_pattern(spec)), F.lit(0))
    for row in df.select("t", F.array_join(parts, "").alias("again")).collect():
        assert row.again == row.t


def test_blank_literals(spark):
    def blanked(spec, text):
        return spark.range(1).select(X.blank_literals(spec, F.lit(text)).alias("b")).first().b

    assert blanked(RUST, 'a // x\nb /* y */ c "d\\"e" f') == 'a \nb   c "" f'
    assert blanked(PYTHON, "a # x\nb '''t'q''' c 'd'") == 'a \nb "" c ""'
    assert blanked(JAVASCRIPT, "`${a}` + 'b'") == '"" + ""'
    assert blanked(GO, "") == ""


def test_new_language_is_one_record(spark):
    swift = replace(GO, language="swift", extensions=(".swift",), signature=r"^func\s+NAME\s*\(")
    found = E.changed_functions(
        diffs(spark, new_file("a.swift", "func go(a: Int) {\n  x()\n}")), specs=(*LANGUAGES, swift)
    ).collect()
    assert [(r.function_name, r.language) for r in found] == [("go", "swift")]


def brute_force_functions(text, spec):
    """Names and texts of functions, found by scanning matches one after the other."""
    reserved = "(?:" + "|".join(JS_RESERVED) + r")\b"
    pattern = spec.signature.replace("(?!" + reserved + ")", "")
    pattern = pattern.replace("INDENT", r"(?P<indent>[ \t]*)", 1)
    for n in range(spec.name_groups):
        pattern = pattern.replace("NAME", rf"(?P<name{n}>\w+)", 1)
    found, spans, matches = [], [], []
    for match in re.finditer(pattern, text, re.MULTILINE):
        name = next(g for k, g in match.groupdict().items() if k.startswith("name") and g)
        if spec is not JAVASCRIPT or name not in JS_RESERVED:
            matches.append((match, name))
    for n, (match, name) in enumerate(matches):
        start, rest = match.start(), text[match.end() :]
        if spec is PYTHON:
            lines = rest.split("\n")
            body = [lines[0]]
            for line in lines[1:]:
                deeper = line.startswith((match["indent"] + " ", match["indent"] + "\t"))
                if line.strip() and not deeper:
                    break
                body.append(line)
            source = match[0] + "\n".join(body)
        elif spec is JAVASCRIPT:
            if any(s <= start < e for s, e in spans):
                continue
            tail = "{" + rest if match[0].endswith("{") else rest
            # A return type never reaches into the next signature.
            following = matches[n + 1][0].start() if n + 1 < len(matches) else len(text)
            if re.match(r"\s*(?::[^;{}]*)?\{", tail[: following - match.end() + len(tail) - len(rest)]):
                end = brute_force_end(tail, "javascript")
                taken = len(text) if end == 0 else match.end() - (len(tail) - len(rest)) + end
            else:
                taken = match.end() + len(re.match(r"[^;\n]*", rest)[0])
            source = text[start:taken]
            spans.append((start, taken))
        else:
            end = brute_force_end(rest, spec.language)
            if spec is RUST and end <= 0:
                continue
            source = text[start : match.end() + end] if end else text[start:]
        found.append((name, source, text[:start].count("\n")))
    return found


def df_functions(df, spec):
    """t and f: the functions by the passes over each text."""
    if spec.body == "indent":
        return df.select("t", X.functions_in(spec, F.col("t")).alias("f"))
    told = X.with_body_ends(df, X.body_end_columns(lambda choose: choose(spec), "t"))
    return told.select("t", X.functions_in(spec, F.col("t"), chunks=F.col("_chunks"), ends=F.col("_ends")).alias("f"))


@pytest.mark.parametrize("windows", [X.BODY_WINDOWS, (1,), (1, 2)], ids=["windows", "one pass", "both"])
@pytest.mark.parametrize("spec", LANGUAGES, ids=lambda s: s.language)
def test_functions_equal_brute_force(spark, monkeypatch, spec, windows):
    monkeypatch.setattr(X, "BODY_WINDOWS", windows)
    pieces = [
        "def f(a):", "  def g(b): return 1", "\tasync def h(", "    x = 1", "  y = {", "}", "  }", "", "   ",
        "function h(x) {", "function i(", "  if (x) {", "while (f(", "const k = y => y", "const of = (a) => {",
        "var m = function (a) { return '}' }", "  get(a) {", "async put(b)", "{", "foo(function (x) {", "bar(a,",
        "fn r<T>(t: T) {", "pub(crate) fn s(", "fn fwd();", "  async fn u() -> X { }", "a: i32)", ") {",
        "func (t *T) M() {", "func N(", '"{', "'}", "`", "// }", "/* {", "*/", "function j(a): Promise<X> {",
    ]
    rng = random.Random(23)
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(16))) for _ in range(2500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    for row in df_functions(df, spec).collect():
        found = [(f.function_name, f.source, f.first_line) for f in row.f]
        assert found == brute_force_functions(row.t, spec), repr(row.t)


def unclosed_text(language, count):
    if language == "javascript":
        return "\n".join(f"function f{i}(a) {{\n  if (a) {{ g(a); }}" for i in range(count))
    return "\n".join(f"fn f{i}(a: i32) {{\n  let s = \"}}\";" for i in range(count))


@pytest.mark.parametrize("spec", [JAVASCRIPT, RUST], ids=lambda s: s.language)
def test_unclosed_bodies_cost_in_proportion(spark, spec):
    import time

    def seconds(count):
        df = spark.createDataFrame([(unclosed_text(spec.language, count),)], "t string")
        start = time.perf_counter()
        found = df_functions(df, spec).select(F.size("f").alias("n"), F.length(F.get("f", F.lit(0))["source"]).alias("size"), F.length("t").alias("all"))
        (row,) = found.collect()
        assert (row.n, row.size) == ((1, row.all) if spec is JAVASCRIPT else (0, None))
        return time.perf_counter() - start

    seconds(500)
    least = {n: min(seconds(n) for _ in range(3)) for n in (2000, 4000)}
    assert least[4000] <= 2.5 * least[2000] + 0.1, least


def test_closed_bodies_among_thousands_of_unclosed_ones(spark):
    text = "func open(a) {\n" * 3000 + "func last() {\n  return \"}\"\n}\n"
    names = df_functions(spark.createDataFrame([(text,)], "t string"), GO)
    (row,) = names.select(F.size("f").alias("n"), F.element_at("f", -1).alias("last"), F.get("f", F.lit(2998))["source"].alias("inner")).collect()
    assert row.n == 3001 and row.last.source == "func last() {\n  return \"}\"\n}" and row.last.first_line == 3000
    assert row.inner == text[15 * 2998 :]
