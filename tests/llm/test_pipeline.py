import hashlib

import corpus_pipeline as P
import messy
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revlake.llm.decontam import find_overlaps
from revlake.llm.tables import written

from test_jaccard import expected as components
from test_linededup import expected as without_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = P.read(spark, SF, "documents").unionByName(
        spark.createDataFrame([(10**6, None, "en", "s", None), (10**6 + 1, "12 34", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    out = [docs]
    for name, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return sorted(df.collect(), key=lambda r: r.doc_id)


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_language_stage_rejects_only_what_has_no_letters(stages):
    assert rows(stages[1]) == [r for r in rows(stages[0]) if any(c.isalpha() for c in r.text or "")]


def test_line_stage(stages):
    before = rows(stages[1])
    gone = without_lines(before)
    want = [(r.doc_id, gone[r.doc_id, r.text][0]) for r in before if not gone[r.doc_id, r.text][1] or gone[r.doc_id, r.text][0].strip(" \t\r\n")]
    assert [(r.doc_id, r.text) for r in rows(stages[2])] == want
    assert all(r.n_chars == len(r.text) for r in rows(stages[2]))


def test_near_copy_stage(stages):
    want = {d for d, _, c in components(stages[2].collect()) if d == c}
    assert {r.doc_id for r in stages[3].collect()} == want and len(want) < stages[2].count()


def test_decontamination_stage(spark, stages):
    items = [" ".join(messy.words(r.text)) for r in P.read(spark, SF, "benchmark").collect()]
    left = rows(stages[4])
    whole = [r.doc_id for r in rows(stages[3]) if any(i in " ".join(messy.words(r.text)) for i in items)]
    assert whole and not set(whole) & {r.doc_id for r in left}
    found = {r.doc_id for r in find_overlaps(stages[3], P.read(spark, SF, "benchmark")).collect()}
    assert [r for r in rows(stages[3]) if r.doc_id not in found] == left


def test_token_stage(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    for before, r in zip(rows(stages[4]), rows(stages[5]), strict=True):
        ids = tokenizer.encode(before.text, add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (before.doc_id, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_is_its_stages(spark, stages):
    assert P.ORACLE_SQL is None
    got = P.run(spark, SF)
    assert rows(got) == rows(stages[5].filter(F.col("doc_id") < 10**6))
