import hashlib
from collections import defaultdict

import messy
from pyspark.sql import functions as F

from revlake.llm import fingerprints as P


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs):
    key = lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or "")
    rows = sorted(docs.collect(), key=key)
    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        m = len(text) // 3
        yield r.doc_id, text, text[: len(text) - m] + after[:m], after


def lowered(text):
    return messy.shingles((text or "").lower())


def check(docs):
    found = defaultdict(list)
    for r in P.fingerprint_documents(docs).collect():
        found[r.doc_id, r.n_chars].append(r)
    n = 0
    for doc_id, text, edited, after in expected(docs):
        n += 1
        digest = hashlib.sha256(edited.encode()).hexdigest()
        r = next(r for r in found[doc_id, len(text)] if r.edited_sha256 == digest)
        assert abs(r.near_edited - likeness(lowered(text), lowered(edited))) < 0.17
        assert abs(r.near_next - likeness(lowered(text), lowered(after))) < 0.17
        size = len(lowered(text))
        assert r.distinct_shingles == size if size < P.K else abs(r.distinct_shingles / size - 1) < 0.35
    assert n == sum(map(len, found.values()))


def test_messy_documents(spark):
    check(messy.documents(spark))


def test_documents_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 7)
    check(messy.documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs)
    by_text = defaultdict(set)
    for r in P.fingerprint_documents(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        by_text[r.text].add(r.fingerprint)
    assert all(len(s) == 1 for s in by_text.values())


def test_rows_without_an_id_and_of_one_id_are_divided(spark):
    from pyspark.sql import functions as F

    # Small partitions would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_divided(spark, F)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def check_divided(spark, F):
    kind = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 70).otherwise(F.col("id"))
    docs = spark.range(60_000).select(kind.cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = P.beside_next(docs, {}).select("doc_id", "text", "next_text", F.spark_partition_id().alias("p"))
    placed = rows.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("k")).agg(F.count("*").alias("n"), F.count_distinct("p").alias("p")).filter("n > 1")
    assert {r.k: r.n for r in placed.collect()} == {-1: 20_000, 70: 20_000} and all(r.p > 3 for r in placed.collect())
    # Walking on from any row meets every row once.
    after = {r.text: r.next_text for r in rows.collect()}
    ids = {r.text: r.doc_id for r in docs.collect()}
    at, seen, order = max((i, t) for t, i in ids.items() if i is not None)[1], set(), []
    while at not in seen:
        seen.add(at)
        order.append(ids[at])
        at = after[at]
    assert len(seen) == len(ids) == 60_000
    assert order == sorted((i for i in order if i is not None), reverse=True) + [None] * 20_000


def test_merging_parts_gives_the_whole(spark):
    parts = spark.createDataFrame([("a", "x" + " one two three four five six seven" * 3), ("a", "p q r s t u"), ("b", "")], "g string, t string")
    sketches = parts.select("g", P.fingerprint(F.col("t"), 4).alias("f"))
    rows = {r.g: r.f for r in P.merged_by(sketches, "g", "f", 4).collect()}
    pair = [r.f for r in sketches.collect() if r.g == "a"]
    both = spark.createDataFrame([tuple(pair)], "a array<long>, b array<long>").select(P.merged(F.col("a"), F.col("b"), 4).alias("m")).first().m
    assert rows == {"a": both} and both == sorted(set(pair[0] + pair[1]))[:4]


def test_containment(spark):
    row = spark.createDataFrame([("a b c d e f g", "a b c d e f g h i j k l m")], "s string, l string").select(
        P.containment(P.fingerprint(F.col("s")), P.fingerprint(F.col("l"))).alias("inside"),
        P.containment(P.fingerprint(F.col("l")), P.fingerprint(F.col("s"))).alias("around"),
    ).first()
    assert abs(row.inside - 1) < 1e-9 and abs(row.around - 3 / 9) < 1e-9


def test_empty_table(spark):
    assert P.fingerprint_documents(messy.empty(spark)).count() == 0
