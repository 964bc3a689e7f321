"""Exact Jaccard join of documents' word shingles as a join in a metric space.

Jaccard distance is a metric. Pivots divide the documents into regions; a
document near the border of a region is replicated into it as far as the
triangle inequality asks, and a region whose documents are not yet settled is
joined by the same means. Two documents link at a distance of EPSILON or less.

Nearly all pairs of texts share nothing and lie at distance 1, where no pivot
tells them apart. So documents first meet through shingles: one that has no
more than its share of shingles in common with any other can't link and goes
(exact, by counting), and each pivot rules the documents that have one of their
rarest shingles in common with it (prefix filter, exact). Within those regions
distances are small enough for pivots and windows to work.

Documents with equal sets are one class and enter once. Documents known to be
connected are not compared any more: components, not all links, are the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.llm import bytetext as B
from revlake.llm.bitmaps import bitmap, passes, unpacked
from revlake.llm.components import components
from revlake.llm.tables import frugal, written

WORDS = 5
ALIKE = 80  # of 100
EPSILON = 1 - ALIKE / 100
LEAF = 64
PIVOTS = 8
FAR = 0.75
#: Of a region with LEAF unsettled members or fewer, the pairs up to which they are compared one by one.
LEAF_PAIRS = 100_000
#: Sets on each side of a block.
BLOCK = 1024
BITMAP_LOG = 26
#: Of larger sets only shingles with a hash below this share are counted first.
SAMPLED = 0.3
_SMALL = 64
_TOP = np.uint64(int(SAMPLED * 2**64))
_PART, _FLUSH = 1 << 20, 500_000


def slack(n):
    """How many of n shingles may be missing from a partner."""
    return n - F.floor((ALIKE * n + 99) / 100)


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows low to high, class keys, where each set begins, and the sorted sets one after another."""
    body, offsets = B.flat(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _PART, "right")) - 1)
        part, at = body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        begins, _, hashes = B.words(part, at, B.NOT_SPACE)
        runs, owner = B.shingles(hashes, B.counts_by_text(begins, at), WORDS)
        order = np.lexsort((runs, owner))
        runs, owner = runs[order], owner[order]
        first = np.append(True, (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1]))[: len(runs)]
        runs, owner = runs[first], owner[first]
        sizes = np.bincount(owner, minlength=high - low)
        starts = np.append(0, np.cumsum(sizes))
        sums = np.append(np.uint64(0), np.cumsum(B.mix(runs ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
        keys = B.mix(sums[starts[1:]] - sums[starts[:-1]] + sizes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        keys[keys == 0] = 1
        yield low, high, keys, starts, runs
        low = high


def document_classes(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (equal for equal sets), how many shingles are counted first, and text_hash."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, keys, starts, runs in _sets(b.column(1)):
                n = np.diff(starts)
                below = np.append(0, np.cumsum(runs < _TOP))
                counted = np.where(n <= _SMALL, n, below[starts[1:]] - below[starts[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(low, high - low), pa.array(n), pa.array(keys.view(np.int64)), pa.array(counted), b.column(2).slice(low, high - low)],
                    names=["doc_id", "n_shingles", "key", "counted", "text_hash"],
                )

    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return texts.mapInArrow(frugal(run), f"doc_id {id_type}, n_shingles long, key long, counted long, text_hash long")


def _pairs_sorted(tokens: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by token, where each token begins, and its number of keys."""
    order = np.lexsort((keys, tokens))
    tokens, keys = tokens[order], keys[order]
    new = np.append(True, (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1]))[: len(tokens)]
    tokens, keys = tokens[new], keys[new]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)])
    return tokens, keys, first, np.diff(np.append(first, len(tokens)))


def shared_shingles(documents: DataFrame, buckets: int) -> DataFrame:
    """key and covered: at least how many counted shingles another class has too, an upper bound.

    Shingles meet in buckets of their hash. What a part of a task already shows
    to be shared is counted there, and goes on once without its keys, so a
    shingle that very many documents have reaches its bucket once a part.
    """

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            for _, _, keys, starts, runs in _sets(b.column(0)):
                n = np.diff(starts)
                # A small set may have a partner a quarter larger, which it must find by all its shingles.
                wanted = (runs < _TOP) | (np.repeat(n, n) <= _SMALL * 5 // 4)
                waiting.append((runs[wanted], np.repeat(keys, n)[wanted]))
                size += int(wanted.sum())
                if size >= _FLUSH:
                    yield from flushed(waiting)
                    waiting, size = [], 0
        if size:
            yield from flushed(waiting)

    def flushed(waiting: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tokens, keys, first, count = _pairs_sorted(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
        here, times = np.unique(keys[np.repeat(count > 1, count)], return_counts=True)
        tokens, keys = tokens[first], np.where(count > 1, np.uint64(0), keys[first])
        rows: dict[int, list[bytes]] = {}
        for place, columns in ((0, (tokens, keys)), (2, (here, times))):
            bucket = (columns[0] & np.uint64(buckets - 1)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))
            columns = [c[order] for c in columns]
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                row = rows.setdefault(k, [b"", b"", b"", b""])
                row[place : place + 2] = [c[cuts[k] : cuts[k + 1]].tobytes() for c in columns]
        names = ["tokens", "keys", "here", "times"]
        arrays = [pa.array([r[i] for r in rows.values()], pa.binary()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), *arrays], names=["bucket", *names])

    def counted(table: pa.Table) -> pa.Table:
        def joined(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

        tokens, keys, first, count = _pairs_sorted(joined("tokens", np.uint64), joined("keys", np.uint64))
        shared = (count > 1) | (keys[first] == 0)
        found = keys[np.repeat(shared, count)]
        found = np.concatenate([found[found != 0], joined("here", np.uint64)])
        times = np.concatenate([np.ones(len(found) - len(joined("here", np.uint64)), np.int64), joined("times", np.int64)])
        kinds, at = np.unique(found, return_inverse=True)
        sums = np.bincount(at, times, len(kinds)).astype(np.int64) if len(kinds) else np.empty(0, np.int64)
        return pa.table({"key": pa.array(kinds.view(np.int64)), "covered": pa.array(sums)})

    schema = "bucket long, tokens binary, keys binary, here binary, times binary"
    indexed = documents.select("text").mapInArrow(frugal(index), schema)
    return indexed.groupBy("bucket").applyInArrow(counted, "key long, covered long").groupBy("key").agg(F.sum("covered").alias("covered"))


def class_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, n and the shingles of the wanted classes (key, rep: a doc_id that has it).

    Documents are told by a bitmap of the ids while that is selective; a larger
    number of ids is joined with the texts instead. Either way an exact join follows.
    """
    ids = wanted.select(F.xxhash64("rep").alias("h"), "rep")
    few = ids.count() <= 1 << (BITMAP_LOG - 2)
    texts = documents.select("doc_id", "text")
    if not few:
        # Rows without an id are not dealt by it: all go on, and their classes are told by the exact join.
        named = texts.join(ids.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        texts = named.unionByName(texts.filter(F.col("doc_id").isNull()))
    seen = documents.sparkSession.sparkContext.broadcast(bitmap(ids, "h", BITMAP_LOG) if few else None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if seen.value is None else unpacked(seen.value)
        for b in batches:
            column = b.column(1)
            if bits is not None:
                hashes = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                column = column.take(pa.array(np.flatnonzero(passes(bits, hashes))))
            for _, _, keys, starts, runs in _sets(column):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(runs.view(np.int64)))],
                    names=["key", "n", "shingles"],
                )

    made = texts.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(frugal(run), "key long, n long, shingles array<long>")
    return made.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def regions_of_rare_shingles(sets: DataFrame) -> DataFrame:
    """region (its pivot's key), key: classes that share one of their rarest shingles with the pivot.

    Of a set's shingles, in ascending order of how many sets have them, the
    first slack + 1 hold one of any partner's first ones. The pivot of a shingle
    is the smallest key that has it there.
    """
    every = sets.select("key", "n", F.explode("shingles").alias("s"))
    known = every.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    shared = every.join(known, "s").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shared"))
    left = F.lit(1) + slack(F.col("n")).cast("long") - (F.col("n") - F.size("shared"))
    first = shared.withColumn("left", left.cast("int")).filter("left > 0").select("key", F.explode(F.slice("shared", 1, F.col("left"))).alias("z"))
    postings = written(first.select("key", F.col("z.s").alias("s")), "postings")
    pivots = postings.groupBy("s").agg(F.min("key").alias("region"), F.count("*").alias("n")).filter("n > 1").select("s", "region")
    return postings.join(pivots, "s").filter("key <> region").select("region", "key").distinct()


def measured(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs with their distance and whether they link."""
    one = sets.select(F.col("key").alias(a), F.col("n").alias("_na"), F.col("shingles").alias("_sa"))
    two = sets.select(F.col("key").alias(b), F.col("n").alias("_nb"), F.col("shingles").alias("_sb"))
    both = pairs.join(one, a).join(two, b).withColumn("_i", F.size(F.array_intersect("_sa", "_sb")).cast("long"))
    union = F.col("_na") + F.col("_nb") - F.col("_i")
    return both.select(*pairs.columns, (1 - F.col("_i") / union).alias("d"), (100 * F.col("_i") >= ALIKE * union).alias("link"))


def _edges(found: DataFrame, a: str, b: str) -> DataFrame:
    return found.filter("link").select(F.col(a).alias("a"), F.col(b).alias("b"))


def _near(x: str | Column, y: str | Column) -> Column:
    """Triangle inequality: of linked documents the distances to a pivot differ by EPSILON at most."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.abs(x - y) <= EPSILON + 1e-9


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the two sides of a block; of each key one to every component it reaches."""
    sides = []
    for left in (True, False):
        rows = table.filter(pc.equal(table.column("left"), left)).combine_chunks()
        lists = rows.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        sides.append((rows.column("key").to_numpy(), rows.column("label").to_numpy(), n, lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)))
    (ka, la, na, sa, oa), (kb, lb, nb, sb, ob) = sides
    common = np.intersect1d(sa, sb)
    shared = np.zeros((len(ka), len(kb)), np.float32)
    for low in range(0, len(common), 2048):
        part = common[low : low + 2048]
        marks = []
        for s, o, rows in ((sa, oa, len(ka)), (sb, ob, len(kb))):
            at = np.minimum(np.searchsorted(part, s), len(part) - 1)
            hit = part[at] == s
            m = np.zeros((rows, len(part)), np.float32)
            m[o[hit], at[hit]] = 1
            marks.append(m)
        shared += marks[0] @ marks[1].T
    both = shared.astype(np.int64)
    link = (100 * both >= ALIKE * (na[:, None] + nb[None, :] - both)) & (la[:, None] != lb[None, :])
    i, j = np.nonzero(link)
    _, first = np.unique(np.column_stack([la[i], j]), axis=0, return_index=True)
    return pa.table({"a": pa.array(ka[i[first]]), "b": pa.array(kb[j[first]])})


def _linked_in_blocks(inside: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of a region's others with its members, block by block; no pair leaves its block unlinked."""
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    held = inside.join(sets.select("key", "shingles"), "key")
    place = F.pmod(F.xxhash64("key", F.lit("block")), parts("all")).cast("int")
    other = F.pmod(F.xxhash64("key", F.lit("block")), parts("others")).cast("int")
    columns = ("region", "key", "label", "shingles")
    left = held.select(*columns, F.lit(True).alias("left"), place.alias("i"), F.explode(F.sequence(F.lit(0), parts("others") - 1)).alias("j"))
    right = held.filter("label <> main").select(
        *columns, F.lit(False).alias("left"), other.alias("j"), F.explode(F.sequence(F.lit(0), parts("all") - 1)).alias("i")
    )
    blocks = left.unionByName(right).groupBy("region", "i", "j")
    return blocks.applyInArrow(_block_links, "a long, b long")


def _to_pivots(regions: DataFrame, chosen: DataFrame, sets: DataFrame) -> DataFrame:
    """region, key, pivot, old (the distance so far), d and link of each member with each pivot of its region.

    A member's set moves once, to its region's few pivots.
    """
    own = chosen.join(sets.withColumnRenamed("key", "pivot"), "pivot")
    pivots = own.groupBy("region").agg(F.collect_list(F.struct("pivot", "n", "shingles")).alias("_pivots"))
    held = regions.select("region", "key", F.col("d").alias("old")).join(sets, "key").join(pivots, "region")
    shared = lambda p: F.size(F.array_intersect("shingles", p["shingles"])).cast("long")
    told = F.transform("_pivots", lambda p: F.struct(p["pivot"].alias("pivot"), p["n"].alias("m"), shared(p).alias("i")))
    rows = held.select("region", "key", "old", "n", F.inline(told)).filter("key <> pivot")
    union = F.col("n") + F.col("m") - F.col("i")
    return rows.select("region", "key", "pivot", "old", (1 - F.col("i") / union).alias("d"), (100 * F.col("i") >= ALIKE * union).alias("link"))


def _cells(regions: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of regions' members with pivots drawn from them, and the members of the regions' cells.

    A member goes into the cell of its nearest pivot and into every other cell
    that may hold a partner: the triangle inequality bounds the distance to its
    pivot by the nearest one's and two EPSILON. A member further than FAR from
    all pivots goes into a cell for these alone, where whoever may be its partner
    goes as well; new pivots divide it. A region of which a cell would
    hold more than three quarters, or whose cells hold two copies of each member
    on average, stays one and is marked whole.
    """
    draw = F.pmod(F.xxhash64("key", "region", F.lit(PIVOTS)), F.lit(1 << 30))
    least = regions.groupBy("region").agg(F.min(F.struct(draw.alias("x"), F.col("key").alias("k")))["k"].alias("sure"))
    chosen = regions.join(least, "region").filter((draw < F.lit(PIVOTS << 30) / F.col("all")) | (F.col("key") == F.col("sure")))
    chosen = chosen.select("region", F.col("key").alias("pivot"))
    found = written(_to_pivots(regions, chosen, sets), "cells")
    unsettled = found.join(chosen.select("region", F.col("pivot").alias("key")), ["region", "key"], "left_anti")
    nearest = unsettled.groupBy("region", "key").agg(F.min("d").alias("best"), F.first("old").alias("old"))
    near = unsettled.join(nearest.drop("old"), ["region", "key"]).filter((F.col("best") <= FAR) & (F.col("d") <= F.col("best") + 2 * EPSILON + 1e-9))
    near = near.select("region", F.xxhash64("region", "pivot").alias("cell"), "key", "d")
    far = nearest.filter(F.col("best") > FAR - EPSILON - 1e-9).select("region", F.xxhash64("region", F.lit("far")).alias("cell"), "key", F.col("old").alias("d"))
    kept = near.unionByName(far)
    cells = kept.groupBy("region", "cell").agg(F.count("*").alias("rows")).groupBy("region").agg(F.sum("rows").alias("rows"), F.max("rows").alias("most"))
    gain = cells.join(nearest.groupBy("region").agg(F.count("*").alias("keys")), "region")
    gain = gain.select("region", ((F.col("rows") <= 2 * F.col("keys")) & (4 * F.col("most") <= 3 * F.col("keys"))).alias("split"))
    divided = kept.join(gain.filter("split"), "region").select(F.col("cell").alias("region"), "key", "d", F.lit(False).alias("whole"))
    whole = nearest.join(gain.filter("not split"), "region").select("region", "key", F.col("old").alias("d"), F.lit(True).alias("whole"))
    return _edges(found, "key", "pivot"), written(divided.unionByName(whole), "cells-left")


def linked_components(sets: DataFrame) -> DataFrame:
    """key and label of classes that link with another; equal labels are one component."""
    first = written(measured(regions_of_rare_shingles(sets), sets, "key", "region"), "regions")
    edges = _edges(first, "key", "region")
    members = first.select("region", "key", "d", F.lit(False).alias("whole"))
    sizes = sets.select("key", "n")
    while True:
        labels = components(edges)
        named = members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        named = written(named.join(sizes, "key"), "members")
        by_label = named.groupBy("region", "label").agg(F.count("*").alias("m"))
        # Of a region all but the documents of its most frequent component are left to settle.
        open_ = by_label.groupBy("region").agg(
            F.sum("m").alias("all"), F.max("m").alias("most"), F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("labels")
        ).filter("labels > 1")
        open_ = written(open_.select("region", "all", "main", (F.col("all") - F.col("most")).alias("others")), "open-regions")
        if open_.isEmpty():
            return labels
        inside = named.join(open_, "region")
        found = []
        # Few others: each is compared with the members that the window and the sizes leave.
        pairwise = (F.col("others") <= LEAF) & (F.col("others") * F.col("all") <= LEAF_PAIRS)
        few = inside.filter(pairwise)
        other = few.filter("label <> main").select("region", F.col("key").alias("b"), F.col("label").alias("lb"), F.col("d").alias("db"), F.col("n").alias("nb"))
        pairs = few.withColumnRenamed("key", "a").join(other, "region").filter(
            (F.col("label") != F.col("lb")) & _near("d", "db") & (100 * F.least("n", "nb") >= ALIKE * F.greatest("n", "nb"))
        )
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found.append(_edges(measured(pairs, sets, "a", "b"), "a", "b"))
        # More others: pivots, cells around them, and replicas within the windows.
        asks = (F.col("others") > LEAF) & ~F.col("whole")
        many = written(inside.filter(asks).select("region", "key", "d", "all"), "large-regions")
        members = None
        if not many.isEmpty():
            links, members = _cells(many, sets)
            found.append(links)
        # A region that cells can't divide is joined in blocks, as is one with few others but very many members.
        found.append(_linked_in_blocks(inside.filter(~pairwise & ~asks), sets))
        for links in found:
            edges = edges.unionByName(links)
        edges = written(edges.distinct(), "links")
        if members is None:
            return components(edges)


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``document_classes``, and component_id and label (one for each component) of the classes with shingles."""
    rows = written(document_classes(documents), "classes")
    reps = rows.filter("n_shingles > 0").groupBy("key", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("counted").alias("counted"))
    n = rows.count()
    buckets = 1 << max(6, (n // 4000).bit_length())
    covered = shared_shingles(documents, buckets)
    enough = F.coalesce("covered", F.lit(0)) >= F.col("counted") - slack(F.col("n_shingles")).cast("long")
    wanted = written(reps.join(covered, "key", "left").filter(enough).select("key", "rep"), "wanted-classes")
    sets = written(class_sets(documents, wanted), "sets")
    labels = linked_components(sets)
    named = reps.select("key", "n_shingles", "rep").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    lowest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    # Written, so that the join below reads plain exchanges and can split a class of very many copies.
    places = written(named.join(lowest, "label").select("key", "n_shingles", "component_id", "label"), "class-components")
    return rows, places


def jaccard_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every document.

    A-Z as a-z, words are runs without ASCII spaces, and a document's set are
    its distinct runs of five words, or all its words as one run. Two documents
    link when 100 * intersection >= 80 * union; component_id is the smallest
    doc_id that links reach, the own included. Null and empty texts and those
    without words have no shingles and link with nothing. Rows with equal texts
    are linked. A row without an id links like the others, and its component_id
    is null if links reach no id; a repeated id gives a row each. An empty table gives no rows; extra columns
    are ignored. Hashes have 64 bits; apart from their collisions it is exact.
    """
    rows, places = _classes(documents)
    filled = rows.filter("n_shingles > 0").join(places, ["key", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    return filled.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(documents: DataFrame) -> DataFrame:
    """One of the documents of each component, with all its columns: that of the smallest doc_id, null ids last, then text hash.

    Rows of a component that repeat the id and the text are reduced to one of
    them. Rows without shingles link with nothing and all stay.
    """
    rows, places = _classes(documents)
    whole = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash")
    best = rows.filter("n_shingles > 0").groupBy("key", "n_shingles").agg(F.min(whole).alias("best"))
    best = best.join(places, ["key", "n_shingles"]).groupBy("label").agg(F.min("best").alias("best"))
    again = rows.filter("n_shingles > 0").groupBy("doc_id", "text_hash").count().filter("count > 1")
    again = again.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.lit(True).alias("_again"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    kept = best.select("best.doc_id", "best.text_hash").join(again, same, "left").select("doc_id", "text_hash", F.coalesce("_again", F.lit(False)).alias("_again"))
    bare = rows.filter("n_shingles = 0").select("doc_id", "text_hash", F.lit(False).alias("_again")).distinct()
    kept = kept.unionByName(bare).select(F.col("doc_id").alias("_kept"), F.col("text_hash").alias("_kept_hash"), "_again")
    kept = written(kept, "kept")

    def rows_of(few: DataFrame) -> DataFrame:
        on = documents["doc_id"].eqNullSafe(few["_kept"]) & (F.xxhash64(documents["text"]) == few["_kept_hash"])
        return documents.join(few, on, "left_semi")

    found, repeated = rows_of(kept.filter("not _again")), kept.filter("_again")
    return found if repeated.isEmpty() else found.unionByName(rows_of(repeated).dropDuplicates(["doc_id", "text"]))
