"""Periodic runs of words: stretches that repeat a period at least twice.

A word that a run holds occurs in it twice or more. So a word that occurs once
in a segment belongs to no run of it and splits it, and so do the words that
become rare in the smaller segments, until nothing changes. What survives is
scanned lag by lag: a run of period q is a stretch of words equal to those q
places on, and such a stretch holds a whole block of every grid fine enough, so
only blocks are compared at a lag and the hits are extended.

Blocks are compared by the ranks of their halves, doubled from word numbers,
so equal ranks are equal words and nothing rests on hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.llm.tables import text_parts

LEAST = 12


def rare_words_split(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the segments in which every word occurs twice; ``texts`` says which text a word is of.

    A word is alone when its neighbours of the same kind lie outside its
    segment. Only segments that the last round split are looked at again.
    """
    n = len(words)
    order = np.lexsort((np.arange(n), words, texts))
    same = (words[order[1:]] == words[order[:-1]]) & (texts[order[1:]] == texts[order[:-1]])
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    edges = np.flatnonzero(np.diff(texts)) + 1
    begins, ends = np.append(0, edges)[: n and None], np.append(edges, n)[: n and None]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(begins):
        long = ends - begins >= LEAST
        begins, ends = begins[long], ends[long]
        sizes = ends - begins
        first = np.append(0, np.cumsum(sizes))
        place = np.arange(first[-1]) + np.repeat(begins - first[:-1], sizes)
        alone = (before[place] < np.repeat(begins, sizes)) & (after[place] >= np.repeat(ends, sizes))
        sums = np.append(0, np.cumsum(alone))
        stable = sums[first[1:]] == sums[first[:-1]]
        done.append((begins[stable], ends[stable]))
        # The stretches between rare words of the other segments go on.
        cuts = place[alone]
        owner = np.repeat(np.arange(len(begins)), sizes)[alone]
        split = np.flatnonzero(~stable)
        low = np.append(begins[split], cuts + 1)
        high = np.append(ends[split], cuts)
        low, high = np.sort(low), high[np.lexsort((high, np.append(split, owner)))]
        begins, ends = low, high
    return (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, np.int64),) * 2


def _ranks(numbers: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each power of two up to ``longest``: a number for the words from each place on, equal for equal words."""
    out, span = [numbers], 1
    while 2 * span <= longest:
        last = out[-1].astype(np.int64)
        both = last[:-span] * (int(last.max()) + 1) + last[span:]
        out.append(np.unique(both, return_inverse=True)[1].astype(np.int32))
        span *= 2
    return out


def lag_scan(numbers: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run within the segments."""
    nothing = (np.empty(0, np.int64),) * 3
    if not len(begins):
        return nothing
    order = np.argsort(begins - ends, kind="stable")  # longest first: a lag concerns a prefix
    begins, sizes = begins[order], (ends - begins)[order]
    stops = np.cumsum(sizes + 1)
    place = np.arange(stops[-1]) + np.repeat(begins - (stops - sizes - 1), sizes + 1)
    # A segment ends with a number of its own, so nothing equal crosses it.
    closing = np.zeros(stops[-1], bool)
    closing[stops - 1] = True
    line = np.where(closing, 0, numbers[np.minimum(place, len(numbers) - 1)])
    line = np.unique(line, return_inverse=True)[1].astype(np.int64)
    line[closing] = line.max() + 1 + np.arange(len(sizes))
    longest = int(sizes[0])
    ranks = _ranks(line.astype(np.int32), max(LEAST, longest // 2))
    found_at, found_lag = [], []
    for lag in range(1, longest // 2 + 1):
        upto = int(np.searchsorted(-sizes, -max(LEAST, 2 * lag), "right"))
        n = int(stops[upto - 1])
        block = (max(LEAST, 2 * lag) - lag + 1) // 2
        k = block.bit_length() - 1
        head, rest = ranks[k], block - (1 << k)
        at = np.arange(0, n - lag - block + 1, block)
        hit = head[at] == head[at + lag]
        if rest:
            at = at[hit]
            at = at[head[at + rest] == head[at + rest + lag]]
        else:
            at = at[hit]
        if len(at):
            at = at[np.append(True, np.diff(at) != block)]  # one hit for a stretch
            found_at.append(at)
            found_lag.append(np.full(len(at), lag))
    if not found_at:
        return nothing
    at, lag = np.concatenate(found_at), np.concatenate(found_lag)
    low, high = at.copy(), at.copy()
    for k in (*(len(ranks) - 1,) * (longest >> (len(ranks) - 1)), *range(len(ranks) - 1, -1, -1)):
        span, rank = 1 << k, ranks[k]
        back = np.maximum(low - span, 0)
        low = np.where((low >= span) & (rank[back] == rank[np.minimum(back + lag, len(rank) - 1)]), low - span, low)
        there = high + lag < len(rank)
        high = np.where(there & (rank[np.minimum(high, len(rank) - 1)] == rank[np.minimum(high + lag, len(rank) - 1)]), high + span, high)
    end = high + lag
    whole = end - low >= np.maximum(LEAST, 2 * lag)
    low, end, lag = low[whole], end[whole], lag[whole]
    # The same stretch at a multiple of its period is the same run.
    order = np.lexsort((lag, end, low))
    low, end, lag = low[order], end[order], lag[order]
    first = np.append(True, (low[1:] != low[:-1]) | (end[1:] != end[:-1]))[: len(low)]
    low, end, lag = low[first], end[first], lag[first]
    return place[low], place[low] + end - low, lag


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in text_parts(batches):
        lists = pc.ascii_split_whitespace(texts)
        lists = lists.fill_null([])
        flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        filled = np.asarray(pc.not_equal(flat, ""))
        text = np.repeat(np.arange(len(texts)), sizes)[filled]
        flat = flat.filter(pa.array(filled))
        numbers = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        start, end, period = lag_scan(numbers, *rare_words_split(numbers, text))
        order = np.lexsort((period, start))
        start, end, period = start[order], end[order], period[order]
        # A run's words after its first period go.
        depth = np.zeros(len(text) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, end, -1)
        kept = np.cumsum(depth[:-1]) == 0
        ends = np.append(0, np.cumsum(kept))[first].astype(np.int32)
        left = pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(kept)))
        of = text[start] if len(start) else np.empty(0, np.int64)
        entries = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)), entries)
        yield pa.RecordBatch.from_arrays([keys, runs, pc.binary_join(left, " ")], names=["doc_id", "runs", "collapsed"])


def periodic_runs(documents: DataFrame) -> DataFrame:
    """doc_id, runs and the collapsed text of every document.

    Words are runs of characters other than the six ASCII spaces, compared as
    they are. ``runs`` lists start (word, from 0), length and smallest period of
    every stretch of words that repeats its period, has 12 words and two periods
    or more and goes no further on either side; by start, then period.
    ``collapsed`` are the words joined by one space, without those that stand in
    a run after its first period. A null or empty text and one without words
    has no runs and collapses to the empty text. Rows are treated one by one, so
    repeated rows, null ids and ties change nothing. An empty table gives no
    rows; extra columns are ignored. Memory follows the longest text.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    runs = "array<struct<start: bigint, length: bigint, period: bigint>>"
    return documents.select("doc_id", "text").mapInArrow(_runs, f"doc_id {id_type}, runs {runs}, collapsed string")


def with_rewritten_tails(documents: DataFrame) -> DataFrame:
    """The documents; where the CRC-32 of the id divides by ten, the words from one place on repeat a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def tail(s: Column) -> Column:
        n = F.size(s["w"])
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(s["w"], i)), " ")).otherwise(F.col("text"))

    bound = F.transform(F.array(F.struct(words.alias("w"))), tail)[0]
    return documents.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), bound).otherwise(F.col("text")))


def run_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; null without runs) and digests of runs and collapsed text."""
    found = periodic_runs(with_rewritten_tails(documents))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    ).select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.l") / -F.col("best.p")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
