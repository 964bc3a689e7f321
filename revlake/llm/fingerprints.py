"""Bottom-k sketches of documents' word shingles.

A fingerprint holds the k smallest hashes of a text's distinct shingles, in
ascending order, and with fewer than k of them it is the whole set. Fingerprints
of parts merge into that of the whole by keeping the k smallest of both. From
two of them follow resemblance, containment and the number of distinct
shingles. All of it is built-in functions.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5
ROWS_PER_BUCKET = 2000
_FINE = 256
_EMPTY = "cast(array() as array<bigint>)"


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all runs of words of the lower-cased text; a shorter text is one run."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\t-\\r ]+"), "")

    # Bound as a lambda variable: words and their hashes are made once a text.
    return F.transform(F.array(F.transform(found, lambda x: F.xxhash64(x))), _runs(words))[0]


def _runs(words: int):
    def runs(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))
        one = F.array(F.aggregate(h, F.lit(1).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(n >= words, many).when(n > 0, one).otherwise(F.expr(_EMPTY))

    return runs


def fingerprint(text: Column, k: int = K, words: int = WORDS) -> Column:
    """array<bigint>: the k smallest distinct shingle hashes; empty for a text without words."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(df: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """One fingerprint for each key. Hashes are made distinct and ranked before and after the shuffle."""
    hashes = df.select(key, F.explode(column).alias("_hash")).distinct()
    ranked = hashes.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("_hash")))
    return ranked.filter(F.col("_rank") <= k).groupBy(key).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; two empty fingerprints are alike."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; an empty a is contained."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def as_text(a: Column) -> Column:
    """16 hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _share_of(hashed: Column, parts: Column) -> Column:
    """Which of ``parts`` equal ranges of hashes a hash lies in, from 0."""
    return F.shiftright(F.shiftrightunsigned(hashed, 33) * parts, 31)


def _bucket(key: Column, hashed: Column, bounds: list[int], bare: int) -> Column:
    """How many bounds the key has reached; below 0 for null.

    A bound that stands in the list several times is an id of as many buckets'
    rows. Its rows are divided by their hash, the lowest into the highest
    bucket, and rows without an id into ``bare`` buckets in the same way.
    """
    without = -1 - _share_of(hashed, F.lit(bare).cast("long"))
    if not bounds:
        return F.when(key.isNull(), without).otherwise(F.lit(0)).cast("int")
    ids = sorted(set(bounds))
    reached = [bisect.bisect_right(bounds, x) for x in ids]
    table = lambda values, kind: F.from_json(F.lit(json.dumps(values)), kind)  # noqa: E731  (folded to a constant)
    heads = table(ids[::_FINE], "array<bigint>")
    fine = table([ids[i : i + _FINE] for i in range(0, len(ids), _FINE)], "array<array<bigint>>")
    counts = table([0, *reached], "array<int>")
    coarse = F.size(F.filter(heads, lambda h: h <= key))
    inner = F.size(F.filter(F.get(fine, coarse - 1), lambda h: h <= key))
    number = F.when(coarse == 0, 0).otherwise((coarse - 1) * _FINE + inner)
    last = F.get(F.get(fine, coarse - 1), inner - 1)
    copies = F.get(counts, number) - F.get(counts, number - 1)
    top = F.get(counts, number)
    found = F.when(number == 0, 0).when((last == key) & (copies > 1), top - _share_of(hashed, copies.cast("long"))).otherwise(top)
    return F.when(key.isNull(), without).otherwise(found).cast("int")


def beside_next(documents: DataFrame, columns: dict[str, Column], max_buckets: int = _FINE * _FINE) -> DataFrame:
    """Each document's doc_id, text and ``columns``, and as next_* those of the next one by descending id.

    The last document's next is the first. Documents are dealt once, by ranges
    of ids, into sorted buckets of about ROWS_PER_BUCKET rows (more of them
    beyond 130 million rows); the first row of each bucket also goes, as a
    guest, to the end of the bucket before it. ``columns`` are computed behind
    that exchange. Rows of one id follow in order of their texts' hash, null ids
    are last; both are divided over buckets like all others. Ids are integers;
    others are taken while one bucket holds all rows.
    """
    texts = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_text_hash", F.xxhash64("text"))
    sizes = texts.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    buckets = max(1, min(max_buckets, sizes["named"] // ROWS_PER_BUCKET))
    bare = max(1, min(max_buckets, (sizes["n"] - sizes["named"]) // ROWS_PER_BUCKET))
    bounds: list[int] = []
    if buckets > 1:
        parts = [i / buckets for i in range(1, buckets)]
        found = texts.agg(F.percentile_approx("doc_id", parts, 10 * buckets).alias("p")).first()["p"]
        bounds = sorted(int(x) for x in found or [])
    dealt = texts.withColumn("_bucket", _bucket(F.col("doc_id"), F.col("_text_hash"), bounds, bare))
    # One row for each bucket, 2 * max_buckets at most. Its first row has the greatest id, and of that the lowest hash.
    place = F.struct("doc_id", F.bitwise_not("_text_hash").alias("h"))
    firsts = dealt.groupBy("_bucket").agg(F.max(place).alias("_first"))
    order = Window.orderBy(F.desc("_bucket"))
    ring = firsts.select(
        "_bucket", "_first",
        F.coalesce(F.lag("_bucket").over(order), F.min("_bucket").over(Window.partitionBy(F.lit(1)))).alias("_to"),
    )
    joined = dealt.join(F.broadcast(ring), "_bucket")
    homes = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("guest")))
    first = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.bitwise_not("_text_hash") == F.col("_first.h"))
    homes = F.when(first, F.concat(homes, F.array(F.struct(F.col("_to").alias("b"), F.lit(1).alias("guest"))))).otherwise(homes)
    spread = joined.select("doc_id", "text", "_text_hash", F.explode(homes).alias("_home")).select(
        "doc_id", "text", "_text_hash", F.col("_home.b").alias("_bucket"), F.col("_home.guest").alias("_guest")
    )
    order = [F.col("_guest"), F.desc("doc_id"), F.col("_text_hash"), F.col("text")]
    placed = spread.repartition("_bucket").sortWithinPartitions("_bucket", *order).withColumns(columns)
    window = Window.partitionBy("_bucket").orderBy(*order)
    names = ["text", *columns]
    return (
        placed.withColumns({f"next_{c}": F.lead(c).over(window) for c in names})
        .filter(F.col("_guest") == 0).drop("_bucket", "_guest", "_text_hash")
    )


def fingerprint_documents(documents: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness.

    The edited text has its last third (rounded down) replaced by as many first
    code points of the next document's text. A null text is empty and has an
    empty fingerprint. Repeated rows give one row each; an empty table gives none.
    Extra columns are ignored.
    """
    pairs = beside_next(documents, {"_own": fingerprint(F.col("text"), k, words)})
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    made = pairs.select("doc_id", n.cast("long").alias("n_chars"), "_own", F.col("next__own").alias("_next"), edited.alias("_text"))
    made = made.withColumn("_edited", fingerprint(F.col("_text"), k, words))
    own, edited, after = F.col("_own"), F.col("_edited"), F.col("_next")
    return made.select(
        "doc_id", "n_chars", F.sha2("_text", 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"),
        resemblance(own, edited, k).alias("near_edited"), resemblance(own, after, k).alias("near_next"),
        distinct_shingles(own, k).alias("distinct_shingles"), containment(own, edited, k).alias("contained_in_edited"),
    )
