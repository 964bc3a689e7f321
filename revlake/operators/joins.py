"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64

# Catalyst's estimates don't know how large computed columns are, so a lookup is
# broadcast up to this many rows, and counted where the estimate is not tiny.
BROADCAST_ROWS = 100_000
TINY_BYTES = 64 << 10
# Rows a lookup may grow to when it is repeated for its salts. A larger one gets
# fewer salts, down to the least, and one task this many of its repeated rows.
REPEATED_ROWS = SALTS * BROADCAST_ROWS
LEAST_SALTS = 8
TASK_ROWS = 50_000


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_limit(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text.lower().rstrip("b")
    return int(text[:-1]) * units[text[-1]] if text and text[-1] in units else int(text)


def lookup_join(
    facts: DataFrame, lookup: DataFrame, key: str, spread_by: Column, salts: int = SALTS
) -> DataFrame:
    """Left join to a table with one row per key, exact at any size and skew.

    A lookup within the broadcast limit, and of few rows, is left to Catalyst,
    which broadcasts it. A larger one is joined on (key, salt): rows of a hot key are spread by
    ``spread_by`` over ``salts`` partitions and each lookup row is repeated
    once per salt. The salt also keeps a later grouping that starts with the
    key from reusing the join's partitions, where the hot key would sit whole.
    The larger the lookup, the fewer salts, and the number of tasks grows with
    the repeated rows, so that what a task holds doesn't grow.
    """
    size, limit = estimated_bytes(lookup), broadcast_limit(lookup)
    if size <= min(limit, TINY_BYTES):
        return facts.join(lookup, key, "left")
    rows = lookup.count()
    if size <= limit and rows <= BROADCAST_ROWS:
        return facts.join(lookup, key, "left")
    salts = max(min(salts, LEAST_SALTS), min(salts, REPEATED_ROWS // max(rows, 1)))
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    parts = -(-rows * salts // TASK_ROWS)
    if parts > int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        salted, repeated = (side.repartition(parts, key, "_salt") for side in (salted, repeated))
    return salted.join(repeated.hint("merge"), [key, "_salt"], "left").drop("_salt")
