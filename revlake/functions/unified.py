"""Unified-diff expressions.

A diff is one value, so it is taken apart inside its row: files are slices of
its hunks and target line numbers are positions among the target-side lines.
Nothing here needs a shuffle, whatever the sizes of repositories or requests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlake.functions.text import blank_to_null, let, newlines, occurrences, rest_from

# Hunk header and file header forms of the unified format.
HUNK_START = r"(?dm)(?=^@@ -\d)"
HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
TARGET_HEADER = r"^\+\+\+ ([^\t\n\r]+)"
SOURCE_HEADER = r"^--- ([^\t\n\r]+)"
GIT_HEADER = "\ndiff --git "
# Leaves of every line behind the first its sign, of a line with another beginning
# a newline, and nothing of the empty piece behind the last line end.
LINE_BEGINS = r"\A[^\n]*+|\n(?:([-+ \\])[^\n]*+|\z)|(\n)[^\n]*+"
NO_FILE = "/dev/null"

# Longer than any array, and still safe to add to a position.
_ALL = 2**30
# More lines than a text can have; sums of a few such lengths stay integers.
# Arrays are never sized by a header's number.
_NO_LENGTH = 2**28


def hunk_chunks(diff_text: Column) -> Column:
    """The text before the first hunk, then one text per hunk."""
    return F.split(diff_text, HUNK_START, -1)


def _header_number(header: Column, group: int) -> Column:
    return F.regexp_extract(header, HUNK_HEADER, group).try_cast("int")


def _header_length(header: Column, group: int) -> Column:
    """Length of one side: 1 where it is left out; one beyond any text never agrees with lines."""


    def length(digits: Column) -> Column:
        stated = F.least(F.coalesce(digits.try_cast("int"), F.lit(_NO_LENGTH)), F.lit(_NO_LENGTH))
        return F.when(digits == "", F.lit(1)).otherwise(stated)

    return let(F.regexp_extract(header, HUNK_HEADER, group), length)


def header_numbers(header: Column) -> Column:
    """Lengths of both sides, start of the target side and the number behind it, null when it is none."""

    def with_end(h: Column) -> Column:
        return F.struct(
            h["source_length"].alias("source_length"), h["target_start"].alias("target_start"),
            F.try_add(h["target_start"], h["target_length"]).alias("target_end"), h["target_length"].alias("target_length"),
        )

    read = F.struct(
        _header_length(header, 2).alias("source_length"), _header_number(header, 3).alias("target_start"),
        _header_length(header, 4).alias("target_length"),
    )
    return let(read, with_end)


def _is_target(line: Column) -> Column:
    return line.startswith("+") | line.startswith(" ") | (line == "") | (line == "\r")


def _lines_after_header(lines: Column) -> Column:
    """Lines of a hunk chunk without its header and its final line end."""
    ends_empty = F.when(F.element_at(lines, -1) == "", 1).otherwise(0)
    return F.slice(lines, 2, F.greatest(F.size(lines) - 1 - ends_empty, F.lit(0)))


def parsed_hunk(chunk: Column) -> Column:
    """Lengths, start, lines and target-side lines of one hunk chunk."""

    def from_lines(lines: Column) -> Column:
        def numbered(h: Column) -> Column:
            numbers = ("source_length", "target_start", "target_end", "target_length")
            return F.struct(*[h[n].alias(n) for n in numbers], _lines_after_header(lines).alias("lines"))

        return let(let(let(F.get(lines, F.lit(0)), header_numbers), numbered), with_target)

    def with_target(hunk: Column) -> Column:
        # Body lines precede the next file's header, so the first
        # target_length target-side lines are exactly the hunk's own.
        target = F.slice(F.filter(hunk["lines"], _is_target), F.lit(1), hunk["target_length"])
        return let(
            target,
            lambda own: F.struct(
                hunk["source_length"].alias("source_length"),
                hunk["target_start"].alias("target_start"),
                hunk["target_end"].alias("target_end"),
                hunk["target_length"].alias("target_length"),
                hunk["lines"].alias("lines"),
                own.alias("target"),
                F.size(F.filter(own, lambda l: l.startswith("+"))).alias("added"),
            ),
        )

    return let(F.split(chunk, "\n", -1), from_lines)


def added_lines(chunk: Column) -> Column:
    """Added lines of a hunk as (line_no, text) structs.

    The texts still begin with their plus sign. A hunk's target-side lines are
    numbered in order, so no line needs to know the ones before it.
    """


    def numbered(header: Column) -> Column:
        # Neither the header nor the empty piece behind the last line end matters:
        # the one is no target line and the other comes after the hunk's own lines.
        target = F.slice(F.filter(F.split(chunk, "\n", -1), _is_target), F.lit(1), header["target_length"])
        return F.transform(
            target, lambda line, i: F.struct(F.try_add(header["target_start"], i).alias("line_no"), line.alias("text"))
        )

    numbers = let(F.substring_index(chunk, "\n", 1), header_numbers)
    return F.filter(let(numbers, numbered), lambda entry: entry["text"].startswith("+"))


def body_lines(chunk: Column) -> Column:
    """Every body line of a hunk: position, kind, target line (null if removed), text."""

    def entry(pos: Column, kind: Column | str, number: Column, line: Column) -> Column:
        return F.struct(
            pos.alias("pos"),
            (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
            number.alias("target_line"),
            F.substring(line, F.lit(2), F.length(line)).alias("text"),
        )

    def listed(hunk: Column) -> Column:
        placed = F.transform(
            hunk["lines"], lambda line, i: F.struct(i.alias("i"), line.alias("line"))
        )
        removed_count = hunk["source_length"] - hunk["target_length"] + hunk["added"]
        target = F.transform(
            F.slice(
                F.filter(placed, lambda p: _is_target(p["line"])), F.lit(1), hunk["target_length"]
            ),
            lambda p, i: entry(
                p["i"],
                F.when(p["line"].startswith("+"), "+").otherwise(" "),
                F.try_add(hunk["target_start"], i),
                p["line"],
            ),
        )
        removed = F.transform(
            F.slice(
                F.filter(placed, lambda p: p["line"].startswith("-")),
                F.lit(1),
                F.greatest(removed_count, F.lit(0)),
            ),
            lambda p: entry(p["i"], "-", F.lit(None).cast("int"), p["line"]),
        )
        return F.concat(target, removed)

    return let(parsed_hunk(chunk), listed)


def _lines_agree(hunk: Column) -> Column:
    """Compare a parsed hunk's lines with its lengths, line by line."""
    context = hunk["target_length"] - hunk["added"]
    removed = hunk["source_length"] - context
    own = F.slice(
        F.filter(hunk["lines"], lambda l: ~l.startswith("\\")),
        F.lit(1),
        F.greatest(hunk["added"] + context + removed, F.lit(0)),
    )
    return (
        hunk["target_end"].isNotNull()
        & (removed >= 0)
        & (F.size(hunk["target"]) == hunk["target_length"])
        & (F.size(own) == hunk["added"] + context + removed)
        & (F.size(F.filter(own, lambda l: l.startswith("-"))) == removed)
        & (F.size(F.filter(own, lambda l: l.startswith("+"))) == hunk["added"])
        & _headers_pair(hunk, removed)
    )


def _headers_pair(hunk: Column, removed: Column) -> Column:
    """Behind a hunk's own lines a target header needs its source header."""
    plus = F.slice(F.filter(hunk["lines"], lambda l: l.startswith("+")), hunk["added"] + 1, F.lit(_ALL))
    minus = F.slice(
        F.filter(hunk["lines"], lambda l: l.startswith("-")), F.greatest(removed, F.lit(0)) + 1, F.lit(_ALL)
    )
    targets = F.size(F.filter(plus, lambda l: l.startswith("+++ ")))
    return targets <= F.size(F.filter(minus, lambda l: l.startswith("--- ")))


def hunk_is_consistent(chunk: Column) -> Column:
    """Whether a hunk's lines agree with the lengths in its header.

    Counts of line beginnings settle the usual case; anything they leave open,
    such as a following file header, is looked at line by line.
    """

    def counts(text: Column) -> Column:
        def counted(begins: Column) -> Column:
            return F.struct(*[occurrences(begins, sign).alias(name) for name, sign in signs], newlines(begins).alias("odd"))

        return F.struct(
            let(F.substring_index(text, "\n", 1), header_numbers).alias("header"),
            let(F.regexp_replace(text, LINE_BEGINS, "$1$2"), counted).alias("lines"),
        )

    def agree(c: Column) -> Column:
        header, lines = c["header"], c["lines"]
        return (
            header["target_end"].isNotNull()
            & (lines["plus"] + lines["context"] == header["target_length"])
            & (lines["minus"] + lines["context"] == header["source_length"])
            & (lines["odd"] == 0)
        )

    signs = (("plus", "+"), ("minus", "-"), ("context", " "))
    own = F.when(chunk.rlike(GIT_HEADER), F.substring_index(chunk, GIT_HEADER, 1)).otherwise(chunk)
    settled = let(own, lambda text: let(counts(text), agree))
    return F.when(settled, True).otherwise(let(parsed_hunk(chunk), _lines_agree))


def _clean_path(path: Column) -> Column:
    quoted = path.startswith('"') & path.endswith('"')
    bare = F.when(quoted, F.regexp_extract(path, '^"(.*)"$', 1)).otherwise(path)
    stripped = F.regexp_replace(bare, "^[ab]/", "")
    return F.when(quoted, F.concat(F.lit('"'), stripped, F.lit('"'))).otherwise(stripped)


def _last_header(lines: Column, pattern: str, mark: str) -> Column:
    heads = F.filter(lines, lambda l: l.startswith(mark))
    return let(
        heads,
        lambda found: F.when(
            F.size(found) > 0, blank_to_null(F.regexp_extract(F.element_at(found, -1), pattern, 1))
        ),
    )


def _path_from(target_lines: Column, source_lines: Column) -> Column:
    target = _last_header(target_lines, TARGET_HEADER, "+++ ")
    source = _last_header(source_lines, SOURCE_HEADER, "--- ")
    return let(
        F.struct(target.alias("target"), source.alias("source")),
        lambda h: _clean_path(F.when(h["target"] == NO_FILE, h["source"]).otherwise(h["target"])),
    )


def _header_path(text: Column) -> Column:
    """Path of the last file header in a text without hunks; null when it has none."""
    last = lambda header: blank_to_null(F.regexp_extract(text, "(?dms).*" + header, 1))
    path = let(last(TARGET_HEADER), lambda target: F.when(target == NO_FILE, last(SOURCE_HEADER)).otherwise(target))
    return let(path, _clean_path)


def _next_path(chunk: Column) -> Column:
    """Path of the file whose header ends a chunk; null when none does."""

    def behind(hunk: Column) -> Column:
        # Without a git line only the hunk's lengths tell header from body.
        removed = hunk["source_length"] - hunk["target_length"] + hunk["added"]
        plus = F.filter(hunk["lines"], lambda l: l.startswith("+"))
        minus = F.filter(hunk["lines"], lambda l: l.startswith("-"))
        return _path_from(
            F.slice(plus, hunk["added"] + 1, F.lit(_ALL)),
            F.slice(minus, F.greatest(removed, F.lit(0)) + 1, F.lit(_ALL)),
        )

    is_hunk = chunk.startswith("@@ -")
    # Patterns find their place much faster than string functions, which most hunks then don't need.
    return (
        F.when(~is_hunk, _header_path(chunk))
        .when(chunk.rlike(GIT_HEADER), let(rest_from(chunk, F.instr(chunk, GIT_HEADER)), _header_path))
        .when(chunk.rlike(r"\n\+\+\+ "), let(parsed_hunk(chunk), behind))
    )


def _sections(chunks: Column) -> Column:
    heads = F.filter(
        F.transform(chunks, lambda chunk, i: F.struct(i.alias("at"), _next_path(chunk).alias("path"))),
        lambda head: head["path"].isNotNull(),
    )

    def cut(found: Column) -> Column:
        last = F.size(chunks) - 1
        return F.transform(
            found,
            lambda head, j: F.struct(
                head["path"].alias("path"),
                j.alias("file_no"),
                F.slice(
                    chunks, head["at"] + 2, F.coalesce(F.get(found, j + 1)["at"], last) - head["at"]
                ).alias("hunks"),
            ),
        )

    return let(heads, cut)


def _agrees(chunks: Column) -> Column:
    hunks = F.filter(chunks, lambda c: c.startswith("@@ -"))
    rootless = F.get(chunks, F.lit(0)).startswith("@@ -")
    return ~rootless & F.forall(hunks, hunk_is_consistent)


def file_sections(diff_text: Column) -> Column:
    """Files of a diff: path and the texts of its hunks, in order."""
    return let(hunk_chunks(diff_text), _sections)


def diff_is_consistent(diff_text: Column) -> Column:
    """False when a hunk disagrees with its header or belongs to no file."""
    return F.coalesce(let(hunk_chunks(diff_text), _agrees), F.lit(True))


def checked_sections(diff_text: Column) -> Column:
    """ok and files of a diff, from one split; a diff that is not consistent has no files."""

    def both(chunks: Column) -> Column:
        return let(
            F.coalesce(_agrees(chunks), F.lit(True)),
            lambda ok: F.struct(ok.alias("ok"), F.when(ok, _sections(chunks)).alias("files")),
        )

    return let(hunk_chunks(diff_text), both)
