import hashlib
import random
import re
import zlib

import messy
import numpy as np
import pytest

from revlake.llm import runs as R


def all_runs(words):
    """Every maximal repetition of 12 words and two periods or more, by comparing at each lag."""
    found, n = {}, len(words)
    line = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if n else np.empty(0, int)
    for q in range(1, n // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], line[q:] == line[:-q], [0]])))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def check(spark, table):
    rows = table.collect()
    want = sorted((expected(r.doc_id, r.text) for r in rows), key=repr)
    assert sorted((tuple(r) for r in R.run_digests(table).collect()), key=repr) == want
    return want


def texts_with_runs(r, count):
    out = []
    for _ in range(count):
        words = [f"w{r.randint(0, r.choice([1, 2, 3, 6, 40, 400]))}" for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            part = [f"p{r.randint(0, 5)}" for _ in range(r.randint(1, 30))]
            at = r.randint(0, len(words))
            words[at:at] = (part * r.randint(2, 9))[: r.randint(4, 90)]
        out.append(r.choice([" ", "\n", " \t"]).join(words))
    return out


def test_random_words_and_planted_runs(spark):
    r = random.Random(3)
    rows = list(enumerate(texts_with_runs(r, 250)))
    want = check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sum(w[1] > 1 for w in want) > 50 and any(w[1] == 0 for w in want)


@pytest.mark.parametrize("letters", [1, 2, 3, 4])
def test_few_different_words(letters):
    r = random.Random(letters)
    for n in [0, 1, 11, 12, 13, 24, 25, *(r.randint(2, 160) for _ in range(60))]:
        words = np.array([r.randrange(letters) for _ in range(n)], np.int32)
        start, end, period = R.lag_scan(words, *R.rare_words_split(words, np.zeros(n, np.int64)))
        assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == all_runs(words.tolist())


def test_several_texts_do_not_meet():
    words = np.array([1, 2] * 5 + [1, 2] * 8 + [3] * 12)
    texts = np.array([0] * 10 + [1] * 16 + [2] * 12)
    start, end, period = R.lag_scan(words, *R.rare_words_split(words, texts))
    assert sorted(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) == [(10, 26, 2), (26, 38, 1)]


def test_splitting_goes_on_until_nothing_is_rare():
    # x goes, then a and b are alone on their sides, then c and d.
    line = "c a d b x d a c b".split() * 1 + ["z"] + list("eeffee")
    words = np.unique(line, return_inverse=True)[1]
    begins, ends = R.rare_words_split(words, np.zeros(len(line), np.int64))
    assert len(begins) == len(ends) == 0
    period = [f"p{i}" for i in range(9)]
    line = ["s"] + period * 3 + ["t"] + ["u", "v"] * 2 + period[:4]
    words = np.unique(line, return_inverse=True)[1]
    begins, ends = R.rare_words_split(words, np.zeros(len(line), np.int64))
    assert (begins.tolist(), ends.tolist()) == ([1], [28])


def test_long_texts_stay_cheap():
    import time

    for words in (np.zeros(300_000, np.int32), np.tile(np.arange(70_000, dtype=np.int32), 4)):
        start = time.perf_counter()
        found = R.lag_scan(words, *R.rare_words_split(words, np.zeros(len(words), np.int64)))
        assert [x.tolist() for x in found][:2] == [[0], [len(words)]] and time.perf_counter() - start < 60


def test_messy_documents(spark):
    check(spark, messy.documents(spark))
    assert R.run_digests(messy.empty(spark)).count() == 0
    found = {r.doc_id: r for r in R.periodic_runs(messy.documents(spark).filter("doc_id < 3")).collect()}
    assert all(not r.runs and r.collapsed == "" for r in found.values())


def test_given_documents(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) < 9000"))
