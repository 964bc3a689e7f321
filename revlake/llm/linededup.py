"""Removal of passages of three or more lines that stand elsewhere before.

Every three consecutive lines of a text are a window; windows overlap. Of the
places of a repeated window all but the first, by doc_id and line, are later
occurrences; lines that one of them covers are removed, so runs of repeated
windows go as one span. Lines are compared without blanks at their ends, and
windows of blank lines alone don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.llm.tables import unused, written

LINES = 3
_BLANKS = " \t\r"


def _windows(texts: DataFrame) -> DataFrame:
    """A row for each window: its 128-bit hash and its place (id, text hash, line)."""
    trimmed = F.transform(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)))

    def found(lines: Column) -> Column:
        def at(i: Column) -> Column:
            parts = [F.get(lines, i + j) for j in range(LINES)]
            blank = F.lit(True)
            for p in parts:
                blank = blank & (p == "")
            return F.when(~blank, F.struct(i.alias("pos"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2")))

        many = F.transform(F.sequence(F.lit(0), F.size(lines) - LINES), at)
        return F.when(F.size(lines) >= LINES, F.filter(many, lambda w: w.isNotNull()))

    windows = F.transform(F.array(trimmed), found)[0]
    return texts.select("_id", "_hash", F.explode(windows).alias("w")).select(
        "w.h1", "w.h2", F.struct("_id", "_hash", F.col("w.pos").alias("pos")).alias("place")
    )


def repeated_lines(texts: DataFrame) -> DataFrame:
    """_id, _hash and the distinct covered lines (ascending from 0) of texts with later occurrences."""
    windows = _windows(texts)
    repeated = windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Written, so that the join reads both sides from plain exchanges and can
    # split a window that a large share of all texts has.
    later = windows.join(written(repeated, "repeated-windows"), ["h1", "h2"]).filter(F.col("place") != F.col("first"))
    positions = later.groupBy(F.col("place._id").alias("_id"), F.col("place._hash").alias("_hash")).agg(F.collect_set("place.pos").alias("_at"))
    covered = F.flatten(F.transform("_at", lambda p: F.sequence(p, p + LINES - 1)))
    return positions.select("_id", "_hash", F.sort_array(F.array_distinct(covered)).alias("_covered"))


def _deduped(documents: DataFrame, added: list[str]) -> DataFrame:
    """The documents without later occurrences, and the three columns of ``dedup_lines`` under other names."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = repeated_lines(documents.select(F.col("doc_id").alias("_id"), key.alias("_hash"), F.col("text").alias("_text")))
    id_, hash_, gone_ = unused(documents, "_found_id", "_found_hash", "_found_covered")
    found = found.withColumnsRenamed({"_id": id_, "_hash": hash_, "_covered": gone_})
    joined = documents.join(found, documents["doc_id"].eqNullSafe(F.col(id_)) & (key == F.col(hash_)), "left")
    lines, gone = F.split("text", "\n"), F.col(gone_)
    kept = F.transform(
        F.array(F.struct(lines.alias("l"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone).alias("k"))),
        lambda s: F.array_join(F.transform(s["k"], lambda i: F.get(s["l"], i)), "\n"),
    )[0]
    after = F.transform(gone, lambda x: x + 1)
    spans = F.transform(
        F.arrays_zip(F.array_except(gone, after).alias("a"), F.array_except(after, gone).alias("b")),
        lambda z: F.struct(z["a"].alias("begin"), z["b"].alias("end")),
    )
    none = F.expr("cast(array() as array<struct<begin: int, end: int>>)")
    values = (
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)),
        F.when(gone.isNull(), none).otherwise(spans),
    )
    text = F.when(gone.isNull(), F.col("text")).otherwise(kept)
    own = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in documents.columns]
    return joined.select(*own, *(v.alias(c) for v, c in zip(values, added, strict=True)))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The documents with later occurrences removed, all their columns, and three more.

    text is the remaining lines; n_lines counts the lines before, n_removed the
    removed ones, removed lists the spans as array<struct<begin, end>> (lines
    from 0, end exclusive). A text without repeats is returned as it is, a null
    text stays null with 0 lines, a text of fewer than three lines has no
    window, and a text all of whose lines go becomes empty. A null doc_id comes
    before all others. Rows with equal id and text are one document: their
    windows share one place, and such rows get equal results. An empty table
    gives no rows. Columns named as the three new ones are not passed on.
    """
    added = ["n_lines", "n_removed", "removed"]
    return _deduped(documents.drop(*added), added)


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents, with their own columns, less repeated lines; those of which nothing is left go.

    ``n_chars`` follows the text where there is such a column; all other columns
    stay as they are, whatever their names. Null and empty texts stay, repeated
    rows are one document (see ``dedup_lines``), an empty table gives no rows.
    """
    removed = unused(documents, "n_lines", "n_removed", "removed")
    n = F.col(removed[1])
    cleaned = _deduped(documents, removed).filter(~((n > 0) & (F.btrim("text", F.lit(_BLANKS + "\n")) == "")))
    if "n_chars" in documents.columns:
        size = F.char_length("text").cast(documents.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(n > 0, size).otherwise(F.col("n_chars")))
    return cleaned.select(*(F.col(f"`{c}`") for c in documents.columns))
