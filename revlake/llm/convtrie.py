"""The prefix trie of conversations: every distinct beginning, with what its subtree holds.

Conversations with equal turns are one row with a weight. Rows are dealt into
shards by ranges of their turn sequences, so that the conversations of a node
stand next to each other. A shard is a matrix of turn numbers padded with zero;
it is sorted, and where a row differs from the one above in a column or in one
before, a node starts. Each depth is then summed over its runs of rows.

Every shard also sees the last row of the shard before and the first of the
next, which carry no weight. So each node starts in one shard only, and what a
shard says of a node that goes on beyond it can be added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.llm.bytetext import mix
from revlake.llm.tables import written

#: Turns of a shard, and columns of a matrix: long rows go on in further matrices.
SHARD_TURNS = 200_000
WIDTH = 32
_NONE = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, "
    "edge boolean, k1 long, k2 long, under_edge boolean, p1 long, p2 long"
)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns: for each turn two hashes of role and text and the text's UTF-8 bytes, in order.

    Order is by turn, null first, then by role, bytes and hash. A null role or
    text counts as empty; rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        "turn", role.alias("role"), F.octet_length(text).cast("long").alias("bytes"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), role, text).alias("b"),
    )
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["bytes"].alias("bytes"))).alias("turns"))


def branched(sequences: DataFrame) -> DataFrame:
    """Every conversation c anew: the first h turns of conversation c - c % 5, then its own after its first h; h is the CRC-32 of c modulo 9."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    base = sequences.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("_base"), F.col("turns").alias("_first"))
    joined = sequences.join(base, F.col("conv_id") - F.col("conv_id") % 5 == F.col("_base"), "left")
    none = F.slice("turns", 1, 0)
    first = F.coalesce(F.slice("_first", 1, h), none)
    return joined.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by sequence and conv_id: the smallest conv_id of each sequence, their number, and the digest of all."""
    now, sha, least, count = None, None, 0, 0
    for b in batches:
        k1, k2, ids = (b.column(i).to_numpy() for i in range(3))
        first = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))[: len(k1)])
        out: list[tuple] = []
        for low, high in zip(first.tolist(), np.append(first[1:], len(k1)).tolist(), strict=True):
            if (k1[low], k2[low]) != now:
                if now:
                    out.append((least, count, sha.hexdigest()))
                now, sha, least, count = (k1[low], k2[low]), hashlib.sha256(), int(ids[low]), 0
            sha.update((("," if count else "") + ",".join(map(str, ids[low:high].tolist()))).encode())
            count += high - low
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["conv_id", "n", "ends"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (least, count, sha.hexdigest())], names=["conv_id", "n", "ends"])


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """conv_id (the smallest), n, ends and turns of each distinct sequence.

    Only hashes and ids are dealt by sequence; however many conversations share
    one, their ids pass through its task in order and are not held there.
    """
    ids = sequences.select(F.xxhash64("turns").alias("k1"), F.xxhash64(F.lit("second"), "turns").alias("k2"), "conv_id")
    sorted_ids = ids.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
    return sorted_ids.mapInArrow(_digests, "conv_id long, n long, ends string").join(sequences, "conv_id")


class _Shard:
    """The rows of a shard in order, and matrices of their turns."""

    def __init__(self, table: pa.Table) -> None:
        a, b, size = (table.column(c).combine_chunks() for c in ("a", "b", "bytes"))
        self.lens = a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.append(0, np.cumsum(self.lens))
        self.a, self.b, self.size = (c.flatten().to_numpy(zero_copy_only=False) for c in (a, b, size))
        # Turns are numbered from 1 in the order of their hashes.
        order = np.lexsort((self.b, self.a))
        new = np.append(True, (np.diff(self.a[order]) != 0) | (np.diff(self.b[order]) != 0))[: len(order)]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new)
        self.order = self._sorted()

    def matrix(self, flat: np.ndarray, rows: np.ndarray, chunk: int) -> np.ndarray:
        """The rows' values in the columns of a chunk, padded with zero."""
        have = np.minimum(self.lens[rows] - chunk * WIDTH, WIDTH)
        out = np.zeros((len(rows), int(have.max(initial=0))), flat.dtype)
        inside = np.arange(out.shape[1]) < have[:, None]
        out[inside] = flat[(self.at[rows, None] + chunk * WIDTH + np.arange(out.shape[1]))[inside]]
        return out

    def chunks(self) -> range:
        return range(-(-int(self.lens.max(initial=0)) // WIDTH))

    def _sorted(self) -> np.ndarray:
        order = np.arange(len(self.lens))
        for chunk in reversed(self.chunks()):  # stable, the last columns first
            longer = self.lens[order] > chunk * WIDTH
            rows = order[longer]
            order = np.append(order[~longer], rows[np.lexsort(self.matrix(self.number, rows, chunk).T[::-1])])
        return order


def _shard_nodes(table: pa.Table) -> pa.Table:
    shard = _Shard(table)
    order, lens = shard.order, shard.lens[shard.order]
    ghost = table.column("ghost").to_numpy()[order] != 0
    weight = np.where(ghost, 0, table.column("n").fill_null(0).to_numpy()[order])
    conv = np.where(ghost, _NONE, table.column("conv_id").fill_null(0).to_numpy()[order])
    ends = table.column("ends").combine_chunks().take(pa.array(order))
    own = ~ghost
    n = len(order)
    # How much of each row is as in the row above, by masks that stay set once a column differs.
    alike, differs, masks = np.zeros(n, np.int64), np.zeros(n, bool), []
    for chunk in shard.chunks():
        rows = np.flatnonzero(lens > chunk * WIDTH)
        matrix = shard.matrix(shard.number, order[rows], chunk)
        change = np.ones(matrix.shape, bool)
        change[1:] = (matrix[1:] != matrix[:-1]) | (np.diff(rows) != 1)[:, None]
        change[:, 0] |= differs[rows]
        starts = np.logical_or.accumulate(change, axis=1)
        differs[rows] = starts[:, -1]
        alike[rows] += ((matrix > 0) & ~starts).sum(axis=1)
        masks.append((rows, matrix > 0, starts))
    leaf = own & np.append(alike[1:] != lens[:-1], True)[:n]
    sums = np.append(0, np.cumsum(shard.size))
    total = sums[shard.at[order] + lens] - sums[shard.at[order]]
    known = sums[shard.at[order] + alike] - sums[shard.at[order]]  # bytes of nodes that started above
    before = np.zeros(n, np.int64)
    key = np.zeros((2, n), np.uint64)
    found: list[list[np.ndarray]] = []
    of = np.zeros(n, np.int64)  # the row's node, a depth higher
    parents: dict[str, np.ndarray] = {"conv": np.array([0]), "edge": np.array([False]), "key": np.zeros((2, 1), np.uint64)}

    def level(depth: int, rows: np.ndarray, starts: np.ndarray) -> None:
        nonlocal parents
        first = np.flatnonzero(starts)
        head = rows[first]

        def add(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values[rows].astype(np.int64), first)

        members = add(weight)
        left = weight * (total - before) - np.where(own, total - np.maximum(before, known), 0)
        here = {"conv": np.minimum.reduceat(conv[rows], first), "edge": add(ghost) > 0, "key": key[:, head]}
        up = of[head]
        end = np.where(lens[head] == depth, head, n)
        columns = [
            here["conv"], np.full(len(first), depth), parents["conv"][up], members, add(own & (lens > depth) & (alike <= depth)),
            add(leaf), add(left), end, here["edge"], *here["key"].view(np.int64), parents["edge"][up], *parents["key"][:, up].view(np.int64),
        ]
        found.append([c[members > 0] for c in columns])
        of[rows] = np.cumsum(starts) - 1
        parents = here

    if n:
        level(0, np.arange(n), np.append(True, np.zeros(n - 1, bool)))
    for chunk, (rows, there, starts) in enumerate(masks):
        a, b, size = (shard.matrix(x, order[rows], chunk) for x in (shard.a, shard.b, shard.size))
        for k in range(there.shape[1]):
            some = there[:, k]
            at = rows[some]
            key[0, at] = mix(key[0, at] * np.uint64(0x9E3779B97F4A7C15) + a[some, k].view(np.uint64) + np.uint64(1))
            key[1, at] = mix((key[1, at] + np.uint64(0xD1342543DE82EF95)) ^ mix(b[some, k].view(np.uint64)))
            level(chunk * WIDTH + k + 1, at, starts[some, k])
            before[at] += size[some, k]
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 14
    arrays = [pa.array(c) for c in columns]
    arrays[7] = pa.concat_arrays([ends, pa.nulls(1, ends.type)]).take(arrays[7]) if found else pa.array([], pa.string())
    root = columns[1] == 0
    arrays[2] = pa.array(columns[2], mask=root)
    return pa.table(arrays, names=[c.split()[0] for c in _NODES.split(", ")])


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """A row for each distinct beginning of the sequences (conv_id, turns), from the empty one.

    conv_id (the smallest member), depth, parent_conv_id (the parent's conv_id;
    root: null), n_convs, n_children, n_leaves (nodes without children in the
    subtree), saved_tokens (over the subtree, each node's members less one times
    the bytes of its last text) and ends_sha256 (of the ids of the members that
    end here, ascending, joined by commas). Turns are equal when their hashes of
    128 bits are. Without conversations there are no rows.

    A conversation is one value and must fit in memory; how many share turns or
    are equal doesn't matter.
    """
    rows = written(distinct_sequences(sequences), "sequences")
    turns = F.col("turns")
    flat = rows.select("conv_id", "n", "ends", *(turns[c].alias(c) for c in ("a", "b", "bytes")))
    cells = flat.agg(F.sum(F.size("a"))).first()[0] or 0
    shards = flat.repartitionByRange(1 + cells // SHARD_TURNS, F.arrays_zip("a", "b")).withColumn("shard", F.spark_partition_id())
    shards = written(shards, "shards")
    line = F.arrays_zip("a", "b")
    bounds = shards.groupBy("shard").agg(F.min(line).alias("low"), F.max(line).alias("high"))
    # One row a shard.
    near = Window.orderBy("shard")
    bounds = bounds.select("shard", F.lag("high").over(near).alias("last"), F.lead("low").over(near).alias("next"))
    ghosts = F.array(*(F.struct(F.lit(i).alias("ghost"), F.col(c).alias("line")) for i, c in ((-1, "last"), (1, "next"))))
    bounds = bounds.select("shard", F.explode(ghosts).alias("g")).filter("g.line is not null")
    bounds = bounds.select("shard", "g.ghost", *(F.col("g.line")[c].alias(c) for c in ("a", "b")))
    bounds = bounds.withColumn("bytes", F.transform("a", lambda x: F.lit(0).cast("long")))
    both = shards.withColumn("ghost", F.lit(0)).unionByName(bounds, allowMissingColumns=True)
    nodes = written(both.groupBy("shard").applyInArrow(_shard_nodes, _NODES), "nodes")
    # Nodes that go on in another shard are added up; then they and their children learn their parents.
    key = ["depth", "k1", "k2"]
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    edge = nodes.filter("edge").groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums), F.max("ends").alias("ends"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
    )
    parents = edge.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", *sums, "ends"]
    open_ = nodes.filter("not edge and under_edge").select(*columns, "p1", "p2").unionByName(edge.select(*columns, "p1", "p2"))
    told = open_.join(parents, ["depth", "p1", "p2"], "left")
    inner = nodes.filter("not edge and not under_edge")
    columns.insert(2, "parent_conv_id")
    every = inner.select(*columns).unionByName(told.select(*columns))
    return every.withColumn("ends_sha256", F.coalesce("ends", F.lit(_EMPTY))).drop("ends")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_nodes`` of the ``branched`` conversations.

    Null roles and texts are empty, null turns come first, rows without a
    conv_id are left out, repeated rows are turns of their own. An empty table
    gives no rows; extra columns are ignored.
    """
    return prefix_nodes(written(branched(turn_sequences(conversations)), "rebuilt"))
