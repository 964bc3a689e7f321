import zlib

import messy
import numpy as np
import pytest
from pyspark.sql import functions as F

from revlake.llm import langid, quality

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_of_held_out_documents(spark, docs):
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify_languages(docs).collect()
    assert {r.doc_id for r in rows} == set(lang)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_languages_of_messy_documents(spark, docs):
    odd = messy.documents(spark)
    model = langid.fit(docs, per_lang=100)
    rows = langid.predict(odd, model, odd.columns).collect()
    assert len(rows) == odd.count()
    by_text = {}
    for r in rows:
        text = r._carried_1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")), text
        assert by_text.setdefault(text, (r.lang_pred, r.score)) == (r.lang_pred, r.score)
    kept = langid.with_language(odd)
    assert kept.columns == odd.columns
    assert kept.count() == sum(any(c.isalpha() for c in r.text or "") for r in odd.collect())


def test_nothing_labelled_or_nothing_there(spark, docs):
    bare = docs.limit(5).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.identify_languages(bare).collect()} == {("und", 0.0)}
    assert langid.with_language(bare).count() == 5
    assert langid.identify_languages(messy.empty(spark)).count() == 0 == langid.with_language(messy.empty(spark)).count()


def test_counts_do_not_depend_on_parts(monkeypatch):
    text = "Ab c, d! é xyz" * 9
    body, offsets = np.frombuffer((text + "zz").encode(), np.uint8), np.array([0, len(text.encode()), len(text.encode()) + 2])
    whole = langid.ngram_counts(body, offsets)
    monkeypatch.setattr(langid, "_PART", 5)
    assert (langid.ngram_counts(body, offsets) == whole).all()


def test_support_vectors_separate():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0, 0, 1]) + 0.3 > 0, 1.0, -1.0)
    w = langid.svm_weights(np.hstack([x, np.ones((300, 1), np.float32)]), y)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.97


def test_quality_of_held_out_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert set(rows) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held_out(r.doc_id) for r in rows.values())
    known = [(rows[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in rows and held_out(r.doc_id)]
    assert np.mean([r.predicted == q for r, q in known]) > 0.95


def test_quality_of_messy_documents(spark):
    odd = messy.documents(spark)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 1), (3, None, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = quality.score_documents(odd, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 0)}
    one = quality.score_documents(odd, labels.filter("quality = 1")).collect()
    assert all(r.score > 0.9 for r in one)
    assert quality.score_documents(messy.empty(spark), labels).count() == 0


def test_isotonic_pools_violators():
    assert quality.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.array([1.0, 1.0, 3.0, 1.0])).tolist() == [1.0, 2.25, 2.25, 4.0]


def test_statistics_do_not_depend_on_neighbours():
    import pyarrow as pa

    from revlake.llm import bytetext as B

    texts = messy.texts()
    together = quality.statistics(*B.flat(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(*B.flat(pa.array([t], pa.string())))[0], together[i]), t[:50]


def test_every_language_is_learnt(spark):
    rows = [(i, f"x{i % 250:03d}", f"word{chr(97 + i % 250 % 26)} " + chr(0x4E00 + i % 250) * 9) for i in range(2500)]
    rows += [(3000 + i, ("en-GB", "en-US", "de")[i % 3], ("colour lift", "color elevator", "farbe aufzug")[i % 3] + f" {i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    model = langid.fit(docs)
    assert len(model.langs) == 253
    names = [sorted(model.langs[i] for i in f) for f in model.families]
    assert ["en-GB", "en-US"] in names and ["de"] in names and all(len(n) == 1 for n in names if n != ["en-GB", "en-US"])
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert np.mean([found[i] == lang for i, lang, _ in rows]) > 0.95


@pytest.mark.parametrize(("fold3", "others"), [(3, 40), (0, 40), (30, 0), (0, 0)])
def test_quality_with_few_labels_in_a_fold(spark, docs, fold3, others):
    def bucket(i):
        return zlib.crc32(str(i).encode()) % 4

    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    chosen = [i for i in ids if bucket(i) == 3][:fold3] + [i for i in ids if bucket(i) in (0, 1)][:others]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(chosen)], "doc_id long, quality int")
    stats = quality.document_statistics(docs)
    model = quality.fit(stats, labels)
    assert (model.weights is not None) == bool(chosen) and (model.steps is not None) == bool(fold3 and others)
    scores = [r.score for r in quality.score_documents(docs.limit(50), labels).collect()]
    assert len(scores) == 50 and all(0 <= s <= 1 for s in scores)
