"""Benchmark passages in training texts, by spaced seeds.

A mask tells which words of a run count; a seed is the hash of the words that
do. A substituted word under a free position leaves the seed equal, so seeds of
test and training texts meet although words differ. Around each meeting the two
texts are compared word by word, and a stretch counts as an overlap when it is
long enough and alike enough.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm import bytetext as B
from revlake.llm.bitmaps import Packed, bitmap, passes, unpacked
from revlake.llm.tables import frugal, parts, unused, written

#: Fixed masks: 1 counts, 0 is ignored.
MASKS = ("1110111", "11010111", "1101100101", "101101011")
LEAST_WORDS = 12
LEAST_SHORT = 5
ALIKE = 0.8
REACH = 48
#: Bits of the bitmap for each seed, and the limits of its size: 512 KB to 128 MB.
BITS, BITMAP_LOGS = 1 << 14, (22, 30)
_SPAN = max(map(len, MASKS))
#: What a word that isn't equal costs, in equal words.
_OTHER = round(ALIKE / (1 - ALIKE))


def seed_hashes(hashes: np.ndarray, counts: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and seed of every run of words under a mask; runs do not cross texts."""
    n, span = len(hashes), len(mask)
    if n < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    out = np.full(n - span + 1, np.uint64((number + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    factors = B.stream(101, span) | np.uint64(1)
    for j, counted in enumerate(mask):
        if counted == "1":
            out += hashes[j : n - span + 1 + j] * factors[j]
    left = np.repeat(np.cumsum(counts), counts)[: n - span + 1] - np.arange(n - span + 1)
    at = np.flatnonzero(left >= span)
    return at, B.mix(out[at])


def _items(benchmark: DataFrame) -> DataFrame:
    """item, words (hashes), and for each seed its hash and place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, offsets = B.flat(b.column(1))
            begins, _, hashes = B.words(body, offsets, B.ALNUM)
            counts = B.counts_by_text(begins, offsets)
            first = np.append(0, np.cumsum(counts))
            words, seeds, places = [], [], []
            for i in range(len(b)):
                own = hashes[first[i] : first[i + 1]]
                words.append(own.tobytes())
                found, at = [], []
                # A text too short for the masks is one seed of all its words.
                masks = enumerate(MASKS) if len(own) >= _SPAN else [(len(own), "1" * len(own))] if len(own) >= LEAST_SHORT else []
                for number, mask in masks:
                    p, h = seed_hashes(own, np.array([len(own)]), mask, number if len(own) >= _SPAN else 100 + number)
                    found += h.view(np.int64).tolist()
                    at += p.tolist()
                seeds.append(found)
                places.append(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(words, pa.binary()), pa.array(seeds, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                names=["item_id", "words", "seeds", "places"],
            )

    id_type = benchmark.schema["item_id"].dataType.simpleString()
    found = benchmark.select("item_id", F.lower("text").alias("text")).mapInArrow(run, f"item_id {id_type}, words binary, seeds array<long>, places array<int>")
    return found.withColumn("_item", F.monotonically_increasing_id())


def _regions(documents: DataFrame, seen: Packed, short: list[int]) -> DataFrame:
    """Stretches of texts around seeds that the bitmap lets pass, with their words and seeds."""
    shared = documents.sparkSession.sparkContext.broadcast(seen)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    masks = [*enumerate(MASKS), *((100 + n, "1" * n) for n in short)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(shared.value)
        for b in (b.slice(low, high - low) for b in batches for low, high in parts(b.column(2))):
            body, offsets = B.flat(b.column(2))
            begins, _, hashes = B.words(body, offsets, B.ALNUM)
            counts = B.counts_by_text(begins, offsets)
            first = np.append(0, np.cumsum(counts))
            at, seeds = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for number, mask in masks:
                p, h = seed_hashes(hashes, counts, mask, number)
                passed = passes(bits, h)
                at.append(p[passed])
                seeds.append(h[passed])
            at, seeds = np.concatenate(at), np.concatenate(seeds)
            order = np.argsort(at, kind="stable")
            at, seeds = at[order], seeds[order]
            if not len(at):
                continue
            doc = np.searchsorted(first, at, "right") - 1
            new = np.append(True, (np.diff(at) > 2 * REACH) | (np.diff(doc) != 0))
            low, high = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at))
            rows: list[list] = [[], [], [], [], []]
            for a, z in zip(low.tolist(), high.tolist(), strict=True):
                d = doc[a]
                begin = max(int(first[d]), int(at[a]) - REACH)
                end = min(int(first[d + 1]), int(at[z - 1]) + _SPAN + REACH)
                for column, value in zip(rows, (int(d), begin - int(first[d]), hashes[begin:end].tobytes(), (at[a:z] - begin).astype(np.int32), seeds[a:z].view(np.int64)), strict=True):
                    column.append(value)
            which = pa.array(rows[0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(which), b.column(1).take(which), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.list_(pa.int32())), pa.array(rows[4], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "start", "doc_words", "at", "seeds"],
            )

    texts = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.lower("text").alias("text"))
    schema = f"doc_id {id_type}, text_hash long, start long, doc_words binary, at array<int>, seeds array<long>"
    return texts.mapInArrow(frugal(run), schema).withColumn("_region", F.monotonically_increasing_id())


def best_stretch(same: np.ndarray, least: int = 0) -> tuple[int, int] | None:
    """Begin and end of the stretch of best score among those of ``least`` words or more; None if no such stretch has ALIKE equal words.

    A score is the equal words less 4 for each other one, so it is not negative
    where ALIKE or more are equal. Of equal scores the longer stretch counts.
    All of it is in integers.
    """
    n = len(same)
    if n < least:
        return None
    # Scores times n + 1; the rest counts the other words.
    sums = np.append(0, np.cumsum(np.where(same, n + 1, -_OTHER * (n + 1) + 1)))
    lowest = np.minimum.accumulate(sums[: n + 1 - least])
    gains = sums[least:] - lowest
    k = int(np.argmax(gains))
    if gains[k] < 0:
        return None
    return int(np.flatnonzero(sums[: k + 1] == lowest[k])[-1]), least + k


def stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """All disjoint stretches by ``best_stretch``: the best one, then those of what is left on both its sides."""
    found, left = [], [(0, len(same))]
    while left:
        low, high = left.pop()
        best = best_stretch(same[low:high], least)
        if best:
            begin, end = low + best[0], low + best[1]
            found.append((begin, end))
            left += [(low, begin), (end, high)]
    return sorted(found)


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for k, (start, region, item, shift) in enumerate(zip(*(b.column(i).to_pylist() for i in (3, 4, 5, 6)), strict=True)):
            own, test = np.frombuffer(region, np.uint64), np.frombuffer(item, np.uint64)
            low, high = max(0, shift), min(len(own), shift + len(test))
            same = own[low:high] == test[low - shift : high - shift]
            for begin, end in stretches(same, min(LEAST_WORDS, len(test))):
                rows.append((k, start + low + begin, start + low + end, low - shift + begin, int(same[begin:end].sum())))
        if rows:
            which, *columns = zip(*rows, strict=True)
            keep = pa.array(which)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(keep) for i in range(3)), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "text_hash", "item_id", "begin", "end", "item_begin", "equal_words"])


def find_overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each overlap of a document with a benchmark text.

    doc_id, text_hash, item_id, begin and end (words of the document, from 0),
    item_begin, equal_words. Words are runs of letters, digits and characters
    beyond ASCII, in lower case. An overlap has LEAST_WORDS words or more, of which
    ALIKE or more are equal, and is found where a seed of a mask is equal in both
    texts. Overlaps at the same offset with too few equal words between them have
    a row each. A benchmark text shorter than the masks must stand
    whole, and one of fewer than LEAST_SHORT words matches nothing, as do null
    and empty texts. Repeated rows give rows of their own, as far as id and text
    tell them apart. Empty tables give no rows; extra columns are ignored.

    Only a bitmap of 2 to the 22 to 30 bits is broadcast, by the number of seeds, of few seeds its set bits alone;
    beyond some 10 million seeds a foreign seed passes with a chance above 1 in 100. Seeds are joined
    as tables. Texts are cut into parts by bytes, so memory follows the longest.
    """
    items = written(_items(benchmark), "benchmark-items")
    seeds = items.select("_item", "item_id", F.explode(F.arrays_zip("seeds", "places")).alias("z")).select(
        "_item", F.col("z.seeds").alias("seed"), F.col("z.places").alias("place")
    )
    lengths = items.filter(F.octet_length("words") < 8 * _SPAN).select((F.octet_length("words") / 8).cast("int").alias("n")).distinct()
    short = sorted(r["n"] for r in lengths.collect() if r["n"] >= LEAST_SHORT)
    log = min(max((BITS * seeds.count()).bit_length(), BITMAP_LOGS[0]), BITMAP_LOGS[1])
    regions = written(_regions(documents, bitmap(seeds, "seed", log), short), "seed-regions")
    hits = regions.select("_region", F.explode(F.arrays_zip("at", "seeds")).alias("z")).select(
        "_region", F.col("z.at").alias("at"), F.col("z.seeds").alias("seed")
    )
    lines = hits.join(seeds, "seed").select("_region", "_item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    pairs = lines.join(regions.select("_region", "doc_id", "text_hash", "start", "doc_words"), "_region").join(
        items.select("_item", "item_id", "words"), "_item"
    )
    id_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((documents, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {id_type}, text_hash long, item_id {item_type}, begin long, end long, item_begin long, equal_words long"
    return pairs.select("doc_id", "text_hash", "item_id", "start", "doc_words", "words", "shift").mapInArrow(_verified, schema).distinct()


def without_overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that overlap with no benchmark text.

    What overlaps is as in ``find_overlaps``: null and empty texts have no
    overlap and stay, of repeated rows all stay or go. Equal benchmark texts
    count once. Empty tables on either side take nothing away.
    """
    items = benchmark.select("item_id", "text").dropDuplicates(["text"])
    id_, hash_ = unused(documents, "_found_id", "_found_hash")
    found = find_overlaps(documents, items).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    key = F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    return documents.join(found, documents["doc_id"].eqNullSafe(F.col(id_)) & (key == F.col(hash_)), "left_anti")
