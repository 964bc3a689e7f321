import struct
import zlib
from collections import Counter

import messy
import pytest
import xxhash
from pyspark.sql import functions as F

from revlake.llm import sharding as S


def long_hash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def moved(x, n, seed=1):
    a, b = S.sides(n)
    while True:
        left, right = divmod(x, b)
        for i in range(S.ROUNDS):
            if i % 2:
                right = (right + long_hash(left, i, seed) % b) % b
            else:
                left = (left + long_hash(right, i, seed) % a) % a
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 100, 5000])
def test_permutation_is_the_plain_one_and_can_be_undone(spark, n):
    rows = spark.range(n).select("id", S.permuted(F.col("id"), n).alias("p")).withColumn("q", S.restored(F.col("p"), n)).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert all(r.q == r.id and r.p == moved(r.id, n) for r in rows)


def test_messy_documents(spark):
    docs = messy.documents(spark)
    rows = S.shard_documents(docs, 7).collect()
    assert len(rows) == docs.count()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    body = lambda t: (t or "").encode()
    expected = Counter((r.doc_id, len(body(r.text)) + 8, zlib.crc32(body(r.text))) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    in_order = sorted(rows, key=lambda r: r.row_number)
    keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in in_order]
    assert keys == sorted(keys) and [r.row_number for r in in_order] == list(range(len(rows)))
    # Another partitioning gives the same places.
    again = S.shard_documents(docs.repartition(5), 7).collect()
    assert Counter(rows) == Counter(again)


def test_empty_table(spark):
    assert S.shard_documents(messy.empty(spark)).count() == 0


def test_walks_end_and_cost_little_at_any_count(spark):
    import time

    from pyspark.sql import functions as F

    seconds = {}
    for n in (17_000_000, 16_004_001):  # many outer numbers, and fewer
        rows = spark.range(n - 100_000, n).select(F.col("id"), S.permuted(F.col("id"), n).alias("p"))
        rows.write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        rows.write.format("noop").mode("overwrite").save()
        seconds[n] = time.perf_counter() - start
        back = rows.filter((F.col("p") < 0) | (F.col("p") >= n) | (S.restored(F.col("p"), n) != F.col("id")))
        assert back.count() == 0
    assert seconds[16_004_001] <= 1.3 * seconds[17_000_000] + 0.5, seconds
