import random

import pytest
from pyspark.sql import functions as F

from revlake.operators import diffs as D


def table(spark, *texts):
    rows = [("org/a", n, f"t{n}", text) for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "repo_full_name string, pr_number long, pr_title string, diff_text string")


TWO_HUNKS = """diff --git a/app/x.py b/app/x.py
index 1..2 100644
--- a/app/x.py
+++ b/app/x.py
@@ -1,3 +1,4 @@ def head
 keep
--- a comment that looks like a header
++++ an added line that looks like one
+second
 tail
\\ No newline at end of file
@@ -10 +11,2 @@
 ten

+last
"""
# In the second hunk the empty line stands for an empty context line, so the
# header below declares two source and three target lines.
TWO_HUNKS = TWO_HUNKS.replace("@@ -10 +11,2 @@", "@@ -10,2 +11,3 @@")

PLAIN = """--- a/one.go
+++ b/one.go
@@ -1 +1 @@
-old
+new
--- a/two.rs\t2024-01-01
+++ b/two.rs\t2024-01-01
@@ -0,0 +5,2 @@
+a
+b
"""

MIXED = """diff --git a/old.js b/new.js
similarity index 100%
rename from old.js
rename to new.js
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-x
-y
diff --git a/n.tsx b/n.tsx
new file mode 100644
--- /dev/null
+++ b/n.tsx
@@ -0,0 +1 @@
+z
"""


def added(spark, text):
    rows = D.diff_added_lines(table(spark, text)).collect()
    return [(r.path, r.hunk, r.line_no, r.text) for r in rows]


def test_budgets_decide_what_is_body(spark):
    assert added(spark, TWO_HUNKS) == [
        ("app/x.py", 0, 2, "+++ an added line that looks like one"),
        ("app/x.py", 0, 3, "second"),
        ("app/x.py", 1, 13, "last"),
    ]


def test_plain_headers_without_git_lines(spark):
    assert added(spark, PLAIN) == [
        ("one.go", 0, 1, "new"), ("two.rs", 0, 5, "a"), ("two.rs", 0, 6, "b"),
    ]


def test_renames_deletions_and_new_files(spark):
    files = D.diff_files(table(spark, MIXED)).collect()
    assert [f.file_path for f in files] == ["gone.py", "n.tsx"]
    assert added(spark, MIXED) == [("n.tsx", 0, 1, "z")]


def test_all_line_kinds(spark):
    lines = D.diff_lines(table(spark, TWO_HUNKS)).orderBy("hunk", "pos").collect()
    assert [(l.kind, l.target_line) for l in lines] == [
        (" ", 1), ("-", None), ("+", 2), ("+", 3), (" ", 4), (" ", 11), (" ", 12), ("+", 13),
    ]
    assert D.added_only(D.diff_lines(table(spark, TWO_HUNKS))).count() == 3


@pytest.mark.parametrize("text", ["", "not a diff\n", "diff --git a/x b/x\nBinary files differ\n"])
def test_nothing_to_parse(spark, text):
    assert added(spark, text) == []
    assert D.diff_errors(table(spark, text)).count() == 0


def test_inconsistent_hunks_are_reported_per_diff(spark):
    short = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n+b\n"
    long = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,1 @@\n+a\n+b\n-c\n"
    rootless = "@@ -1 +1 @@\n-a\n+b\n"
    bad = D.diff_errors(table(spark, TWO_HUNKS, short, PLAIN, long, rootless, MIXED))
    assert {r.pr_number for r in bad.collect()} == {1, 3, 4}


@pytest.mark.parametrize(
    "path,language",
    [
        ("src/module.py", "python"), ("app/main.js", "javascript"), ("ui/Button.jsx", "javascript"),
        ("types/api.ts", "javascript"), ("ui/Button.tsx", "javascript"), ("lib/h.mjs", "javascript"),
        ("scripts/t.cjs", "javascript"), ("src/main.rs", "rust"), ("cmd/server/main.go", "go"),
        ("README.md", None), ("ci.yaml", None), ("X.PY", None), ("py", None),
    ],
)
def test_dispatch_by_extension(spark, path, language):
    row = spark.range(1).select(D.language_of(F.lit(path)).alias("l")).first()
    assert row.l == language


def test_language_registry(spark):
    assert {r.language for r in D.supported_languages(spark).collect()} == {
        "python", "javascript", "rust", "go",
    }
    names = spark.createDataFrame([("go",), ("cobol",)], "language string")
    known = {r.language: r.k for r in names.select("language", D.known_language(F.col("language")).alias("k")).collect()}
    assert known == {"go": "go", "cobol": None}


def test_exclude_patterns(spark):
    files = spark.createDataFrame(
        [("r", p) for p in ("docs/a.md", "src/deep/x_test.go", "src/x.go", "a.b", "axb")]
        + [("other", "docs/a.md")],
        "repo_full_name string, file_path string",
    )
    configs = spark.createDataFrame(
        [("r", " docs/*, *_test.go ,a.b"), ("other", ""), ("third", None)],
        "repo_full_name string, exclude_patterns string",
    )
    kept = {(r.repo_full_name, r.file_path) for r in D.drop_excluded(files, configs).collect()}
    assert kept == {("r", "src/x.go"), ("r", "axb"), ("other", "docs/a.md")}


def random_diff(rng):
    """A diff text and the added lines it was made from."""
    contents = ["", "x", "++ b/fake.py", "-- a/fake.py", "+", "-", "@@ -1 +1 @@", "diff --git a/q b/q", " ", "\\", "+++ b/z"]
    git = rng.random() < 0.5
    text, expected = "", []
    for n in range(rng.randrange(1, 4)):
        path = f"dir/f{n}.py"
        if git:
            text += f"diff --git a/{path} b/{path}\nindex 1..2 100644\n"
        text += f"--- a/{path}\n+++ b/{path}\n"
        line = 1
        for hunk in range(rng.randrange(1, 4)):
            line += rng.randrange(1, 9)
            body = [(rng.choice("+- "), rng.choice(contents)) for _ in range(rng.randrange(1, 8))]
            source = sum(kind != "+" for kind, _ in body)
            target = sum(kind != "-" for kind, _ in body)
            short = rng.random() < 0.5
            lengths = ["" if short and size == 1 else f",{size}" for size in (source, target)]
            text += f"@@ -{line}{lengths[0]} +{line}{lengths[1]} @@ head\n"
            for kind, content in body:
                text += kind + content + "\n"
                if kind == "+":
                    expected.append((path, hunk, line, content))
                line += kind != "-"
            if rng.random() < 0.2:
                text += "\\ No newline at end of file\n"
    return text, expected


def test_random_diffs_give_back_their_lines(spark):
    rng = random.Random(7)
    made = [random_diff(rng) for _ in range(1500)]
    df = table(spark, *[text for text, _ in made]).repartition(8)
    found = {}
    for r in D.diff_added_lines(df, ("pr_number",)).collect():
        found.setdefault(r.pr_number, []).append((r.path, r.hunk, r.line_no, r.text))
    listed = {}
    for r in D.added_only(D.diff_lines(df, ("pr_number",))).collect():
        listed.setdefault(r.pr_number, []).append((r.path, r.hunk, r.target_line, r.text))
    for n, (text, expected) in enumerate(made):
        assert sorted(found.get(n, [])) == sorted(expected), text
        assert sorted(listed.get(n, [])) == sorted(expected), text
    assert D.diff_errors(df, ("pr_number",)).count() == 0


def test_changed_lengths_are_always_noticed(spark):
    rng = random.Random(9)
    broken = []
    while len(broken) < 500:
        text, _ = random_diff(rng)
        lines = text.split("\n")
        heads = [i for i, line in enumerate(lines) if line.endswith("@@ head")]
        at = rng.choice(heads)
        # One more source line than there is, written out even for a length of one.
        start, size = lines[at].split()[1][1:].partition(",")[::2]
        lines[at] = lines[at].replace(lines[at].split()[1], f"-{start},{int(size or 1) + 1}", 1)
        broken.append("\n".join(lines))
    flagged = D.diff_errors(table(spark, *broken).repartition(8), ("pr_number",)).count()
    assert flagged == 500


def test_globs_equal_fnmatch(spark):
    import random
    from fnmatch import fnmatchcase

    r = random.Random(9)
    piece = lambda: r.choice(["*", "**", "a", "b", "ab", "/", "é", ".", "%", "?", "[ab]"])
    rows = []
    for _ in range(1500):
        plain = r.random() < 0.7
        glob = "".join(p for p in (piece() for _ in range(r.randint(1, 7))) if not (plain and p[0] in "?["))
        path = "".join(r.choice(["a", "b", "/", "é", ".", "%"]) for _ in range(r.randint(0, 9)))
        if glob:
            rows.append((glob, path))
    df = spark.createDataFrame(rows, "g string, p string")
    for row in df.select("g", "p", D.excluded(F.col("p"), D.exclusion_steps(F.col("g"))).alias("hit")).collect():
        assert row.hit == fnmatchcase(row.p, row.g), (row.g, row.p)
