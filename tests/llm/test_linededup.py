import random
from collections import Counter

import messy

from revlake.llm import linededup as D


def expected(rows):
    """doc_id, text -> text and covered lines, by listing every window."""
    order = sorted({(r.doc_id is not None, r.doc_id or 0, r.text) for r in rows if r.text is not None}, key=lambda k: k[:2])
    seen, gone = set(), {}
    for there, doc_id, text in order:
        lines = text.split("\n")
        trimmed = [x.strip(" \t\r") for x in lines]
        covered = set()
        for i in range(len(lines) - 2):
            w = tuple(trimmed[i : i + 3])
            if any(w):
                if w in seen:
                    covered |= {i, i + 1, i + 2}
                seen.add(w)
        gone[(doc_id if there else None), text] = ("\n".join(x for i, x in enumerate(lines) if i not in covered), sorted(covered))
    return gone


def check(spark, docs):
    rows = docs.collect()
    gone = expected(rows)
    out = D.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")] + ["n_lines", "n_removed", "removed"]
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed, tuple(i for s in r.removed for i in range(s.begin, s.end))) for r in out.collect())
    want = Counter()
    for r in rows:
        text, covered = gone.get((r.doc_id, r.text), (None, []))
        want[r.doc_id, text, 0 if r.text is None else r.text.count("\n") + 1, len(covered), tuple(covered)] += 1
    assert got == want


def test_messy_documents(spark):
    check(spark, messy.documents(spark).filter("doc_id is not null and doc_id <> 9000000000"))
    assert D.dedup_lines(messy.documents(spark)).count() == messy.documents(spark).count()
    assert D.dedup_lines(messy.empty(spark)).count() == 0


def test_random_lines(spark):
    r = random.Random(2)
    rows = [(i, "\n".join(r.choice(["a", "b ", "\tb", "c", "", "d"]) for _ in range(r.randint(0, 25)))) for i in range(120)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_stage_drops_what_is_left_empty_and_keeps_the_rest(spark):
    passage = "\n".join(f"line {i} of a passage" for i in range(5))
    rows = [(1, passage, 1), (2, passage, 2), (3, "own\n" + passage + "\nend", 3), (4, "", 0), (5, None, None), (6, "clean text", 77)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in D.without_repeats(docs).collect()}
    assert got == {1: (passage, 1), 3: ("own\nend", 7), 4: ("", 0), 5: (None, None), 6: ("clean text", 77)}


def test_columns_of_any_name_stay_as_they_are(spark):
    docs = messy.documents(spark)
    out = D.without_repeats(docs)
    assert out.schema == docs.schema
    assert all(r[c] == "z" for r in out.collect() for c in messy.EXTRA)
    assert all(r[c] == "z" for r in D.dedup_lines(docs).collect() for c in messy.EXTRA if c not in ("n_lines", "n_removed", "removed"))
    assert D.without_repeats(messy.empty(spark)).count() == 0
