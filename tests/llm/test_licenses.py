import random
import re
from collections import Counter

import messy
import pyarrow as pa
import pytest

from revlake.llm import bytetext as B
from revlake.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def expected(text):
    w = WORD.findall((text or "").translate(messy.LOWER))
    places, labels = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def scan(*texts):
    return list(L.scan(*B.flat(pa.array(texts, pa.string()))))


def test_messy_documents(spark):
    docs = messy.documents(spark)
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan_licenses(docs).collect()]
    assert Counter(got) == Counter((r.doc_id, *expected(r.text)) for r in docs.collect())
    assert L.scan_licenses(messy.empty(spark)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in L.scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected(text[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize("number", range(len(L.NOTICES)))
def test_edited_notices_are_found_wherever_the_pattern_matches(number):
    notice, label = L.NOTICES[number]
    r = random.Random(number)
    texts = []
    for _ in range(60):
        s = list(notice)
        for _ in range(r.randint(0, L.edits_allowed(notice) + 1)):
            i = r.randrange(len(s))
            kind = r.choice("sid")
            s[i : i + (kind != "i")] = [] if kind == "d" else [r.choice("abc éZ-")]
        texts.append("some words é " + "".join(s) + " and more")
    for text, row in zip(texts, scan(*texts), strict=True):
        whole = " ".join(WORD.findall(text.translate(messy.LOWER)))
        assert any(s[1] == notice for s in row[7]) == bool(L._fuzzy(notice).search(whole)), text


def test_spans_and_scores():
    (row,) = scan("é! Licensed under the Apacheé Licence, Version 2.0.")
    assert row[4:6] == ("", "apache") and 0.9 < row[6] < 1
    assert row[7] == [("apache", "licensed under the apache license version 2 0", 1, 8, 2, "licensed under the apacheé licence version 2 0")]
    assert scan("Released under the MIT License.")[0][6] == 1.0 and scan("plain words")[0][4:] == ("", "", 0.0, [])
