"""The fitted models of op5 and op7 rebuilt from their definitions, and the decontamination stage by brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlake.llm import decontam, langid, quality

SF = "/root/testdata/sf0.001"


def bucket(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(150)


def test_quality_scores_follow_their_definition(spark, docs):
    labels = {i: int(k % 3 > 0) for k, i in enumerate(r.doc_id for r in docs.collect()) if k % 10}
    table = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    stats = {r.doc_id: np.array([r[f] for f in quality.FEATURES]) for r in quality.document_statistics(docs).collect()}
    ids = sorted(stats)
    x = np.array([stats[i] for i in ids])
    fold = np.array([bucket(i) for i in ids])
    known = np.array([i in labels for i in ids])
    y = np.array([labels.get(i, 0) for i in ids], float)
    learning = x[fold != 2]
    x = np.clip((x - learning.mean(0)) / np.maximum(np.where(learning.std(0) == 0, 1, learning.std(0)), 1e-6), -5, 5)
    r = np.random.default_rng(17)
    directions = r.normal(size=(x.shape[1], 256)) / np.sqrt(x.shape[1])
    phases = r.uniform(0, 2 * np.pi, 256)
    z = np.array([[*(np.sqrt(2 / 256) * np.cos(row @ directions + phases)), 1.0] for row in x])
    train = known & (fold != 2) & (fold != 3)
    # Ridge as least squares with added rows.
    size = np.sqrt(1e-3 * train.sum())
    added = np.diag([*([size] * 256), np.sqrt(1e-9)])
    w = np.linalg.lstsq(np.vstack([z[train], added]), np.append(y[train], np.zeros(257)), rcond=None)[0]
    raw = np.clip(z @ w, 0, 1)
    held = known & (fold == 3)
    bins = np.rint(raw * 1000).astype(int)
    places = sorted(set(bins[held]))
    values = [y[held & (bins == b)].mean() for b in places]
    weights = [(held & (bins == b)).sum() for b in places]
    mean = lambda a, b: np.dot(values[a : b + 1], weights[a : b + 1]) / sum(weights[a : b + 1])
    # The isotonic fit by its formula: the greatest of the least means around a place.
    fitted = [max(min(mean(a, b) for b in range(i, len(places))) for a in range(i + 1)) for i in range(len(places))]
    want = np.interp(raw, np.arange(1001) / 1000, np.interp(np.arange(1001), places, fitted))
    got = {row.doc_id: row.score for row in quality.score_documents(docs, table).collect()}
    assert np.allclose([got[i] for i in ids], want, atol=1e-4)


def test_languages_follow_their_definition(spark, docs):
    letters = {chr(c) for c in range(97, 123)} | {chr(c) for c in range(65, 91)}
    known = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    model = langid.fit(docs)

    def counts(text):
        raw = (text or "").encode()
        line = bytes(b | 0x20 if chr(b) in letters else b if b >= 0x80 else 0x20 for b in raw)
        out = Counter()
        for k in (1, 2, 3):
            for i in range(len(line) - k + 1):
                gram = line[i : i + k]
                if gram[0] != 0x20 or gram[-1] != 0x20:
                    code = (int.from_bytes(gram, "big") + ((k - 1) << 32)) * 0x9E3779B97F4A7C15 % 2**64 >> 52
                    out[code] += 1
        return np.array([out[i] for i in range(4096)])

    table = {i: counts(t) for i, t, _ in known}
    sample = [(i, lang) for i, t, lang in known if lang and bucket(i) != 2 and any(c.isalpha() for c in t or "")]
    assert model.langs == sorted({lang for _, lang in sample})
    sums = {lang: sum(table[i] for i, x in sample if x == lang) for lang in model.langs}
    for members, logs in zip(model.families, model.family_logs, strict=True):
        shares = np.mean([(sums[model.langs[m]] + 0.5) / (sums[model.langs[m]] + 0.5).sum() for m in members], axis=0)
        assert np.allclose(np.exp(logs), shares)
    unit = lambda c: np.append(np.sqrt(c / max(c.sum(), 1)), 1)
    for (a, b), w in zip(model.pairs, model.weights, strict=True):
        rows = [(unit(table[i]), 1 if lang == model.langs[a] else -1) for i, lang in sample if lang in (model.langs[a], model.langs[b])]
        x, y = np.array([r for r, _ in rows]), np.array([s for _, s in rows])
        # At the optimum the gradient of ridge and mean squared hinge loss is zero.
        inside = y * (x @ w) < 1
        ridge = np.append(np.full(4096, 1e-3), 1e-9)
        assert np.linalg.norm(ridge * w + x.T @ np.where(inside, x @ w - y, 0) / len(x)) < 1e-3
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    for i, text, _ in known:
        if not any(c.isalpha() for c in text or ""):
            assert found[i] == "und"
            continue
        c = table[i]
        family = int(np.argmax([c @ logs for logs in model.family_logs]))
        votes = Counter()
        for (a, b), w in zip(model.pairs, model.weights, strict=True):
            m = unit(c) @ w
            votes[a] += (m > 0) + 1e-3 * np.tanh(m)
            votes[b] += (m <= 0) - 1e-3 * np.tanh(m)
        best = max(model.families[family], key=lambda k: (votes[k], -k))
        assert found[i] == model.langs[best]


def test_decontamination_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 6000)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    items = [w for w in {tuple(words(r.text)) for r in benchmark.collect()} if len(w) >= 5]
    spans = [[j for j, c in enumerate(m) if c == "1"] for m in decontam.MASKS]

    def overlaps(doc, item):
        """Whether at some offset a mask meets and 12 words or more, 80 of 100 equal, stand in line."""
        at = {}
        for i, w in enumerate(item):
            at.setdefault(w, []).append(i)
        for shift in {p - i for p, w in enumerate(doc) for i in at.get(w, ())}:
            low, high = max(0, shift), min(len(doc), shift + len(item))
            same = [doc[p] == item[p - shift] for p in range(low, high)]
            least = min(12, len(item))
            if len(item) < 10:
                if len(same) == len(item) and all(same):
                    return True
                continue
            if not any(all(same[i + j] for j in s) for s, m in zip(spans, decontam.MASKS, strict=True) for i in range(len(same) - len(m) + 1)):
                continue
            sums = np.append(0, np.cumsum([1 if s else -4 for s in same]))
            if any(sums[j] >= sums[: j - least + 1].min() for j in range(least, len(sums))):
                return True
        return False

    rows = docs.collect()
    kept = {r.doc_id for r in decontam.without_overlaps(docs, benchmark).collect()}
    want = {r.doc_id for r in rows if not any(overlaps(words(r.text), i) for i in items)}
    assert kept == want and len(want) < len(rows)
