"""Reproducible shuffle into shards by a Feistel permutation of row numbers.

Rows are numbered in the order of a key. The numbers 0 to n - 1 are permuted by
a generalised Feistel network on pairs (left, right) with left < a, right < b
and a * b just over n; a result of n or more is permuted again (cycle walking)
until it is below n. Shard and slot follow from the permuted number alone, so
where a row lies, and which row lies at a place, can be computed without a
table. No text is moved: only the key and the digest columns are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlake.llm.tables import written

ROUNDS = 6


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def _round(value: Column, i: int, seed: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(i).cast("long"), F.lit(seed).cast("long")), F.lit(modulus).cast("long"))


def _step(i: int, seed: int, a: int, b: int, sign: int):
    def odd(p: Column) -> Column:
        moved = F.pmod(p["r"] + sign * _round(p["l"], i, seed, b), F.lit(b).cast("long"))
        return F.struct(p["l"].alias("l"), moved.alias("r"))

    def even(p: Column) -> Column:
        moved = F.pmod(p["l"] + sign * _round(p["r"], i, seed, a), F.lit(a).cast("long"))
        return F.struct(moved.alias("l"), p["r"].alias("r"))

    return odd if i % 2 else even


def _network(x: Column, n: int, seed: int, rounds: range, sign: int) -> Column:
    a, b = sides(n)
    pair = F.struct(_div(x, b).alias("l"), F.pmod(x, F.lit(b).cast("long")).alias("r"))
    pair = F.struct(F.expr("0L").alias("l"), F.expr("0L").alias("r")) if n == 0 else pair
    for i in rounds:
        # One struct per round keeps the expression linear in the rounds.
        pair = F.transform(F.array(pair), _step(i, seed, a, b, sign))[0]
    return F.transform(F.array(pair), lambda p: p["l"] * b + p["r"])[0]


def _walk(x: Column, n: int, seed: int, rounds: range, sign: int) -> Column:
    a, b = sides(n)
    # A walk meets each of the a * b - n outer numbers once at most, so as many
    # steps always end it. Only the few rows that begin outside walk at all.
    steps = F.sequence(F.lit(1), F.lit(max(1, a * b - n)))

    def inside(first: Column) -> Column:
        walked = F.aggregate(steps, first, lambda y, _: F.when(y < n, y).otherwise(_network(y, n, seed, rounds, sign)))
        return F.when(first < n, first).otherwise(walked)

    return F.transform(F.array(_network(x, n, seed, rounds, sign)), inside)[0]


def permuted(x: Column, n: int, seed: int = 1) -> Column:
    """Where row number x of n goes."""
    return _walk(x, n, seed, range(ROUNDS), 1)


def restored(y: Column, n: int, seed: int = 1) -> Column:
    """The row number that ``permuted`` sends to y."""
    return _walk(y, n, seed, range(ROUNDS - 1, -1, -1), -1)


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Rows with their number from 0 in the given order, without sorting in one task.

    Rows equal in all ``order`` columns get numbers among themselves in any order.
    """
    part, at, start = "_part", "_at", "_start"
    ranged = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(part).count()
    # One row for each partition: a bounded table, summed up in one task.
    starts = sizes.select(part, (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias(start))
    inner = ranged.withColumn(at, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return inner.join(F.broadcast(starts), part).withColumn(name, F.col(start) + F.col(at)).drop(part, at, start)


def shard_documents(documents: DataFrame, shards: int = 24, seed: int = 1) -> DataFrame:
    """Documents' places in ``shards`` shuffled shards whose counts differ by one at most.

    doc_id, size (UTF-8 bytes of the text and 8; a null text has none),
    text_crc32, law ``rows``, shard, slot (gapless from 0), grown_shard (null),
    row_number. Rows are numbered by doc_id, CRC and size; null ids come first;
    repeated rows share a number range and each get their own slot. An empty
    table gives no rows. Extra columns are ignored.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    thin = documents.select(
        F.col("doc_id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32")
    )
    rows = numbered(thin, ["doc_id", "text_crc32", "size"])
    n = rows.count()
    place = permuted(F.col("row_number"), n, seed)
    return rows.withColumn("_place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"), _div(F.col("_place"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
