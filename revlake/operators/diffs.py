"""Diff tables: files, body lines, added lines and added text per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.functions import unified
from revlake.functions.text import pin, reused
from revlake.languages import LANGUAGES, LanguageSpec
from revlake.operators.joins import lookup_join

PR_KEYS = ("repo_full_name", "pr_number")


def language_of(path: Column, specs: tuple[LanguageSpec, ...] = LANGUAGES) -> Column:
    """Language of a path by suffix, case-sensitive; null when none handles it."""
    choice = None
    for spec in specs:
        handled = None
        for extension in spec.extensions:
            test = path.endswith(extension)
            handled = test if handled is None else handled | test
        choice = F.when(handled, spec.language) if choice is None else choice.when(handled, spec.language)
    return choice


def language_table(spark, specs: tuple[LanguageSpec, ...] = LANGUAGES) -> DataFrame:
    """The registered (language, extension) pairs."""
    rows = [(s.language, e) for s in specs for e in s.extensions]
    return spark.createDataFrame(rows, "language string, extension string")


def supported_languages(spark, specs: tuple[LanguageSpec, ...] = LANGUAGES) -> DataFrame:
    return language_table(spark, specs).select("language").distinct()


def known_language(language: Column, specs: tuple[LanguageSpec, ...] = LANGUAGES) -> Column:
    """The language itself when registered, else null."""
    return F.when(language.isin([s.language for s in specs]), language)


# Pieces of a glob: a closed bracket, a run of stars, any other character.
_GLOB_PIECE = r"(?s)\[!?\]?[^\]]*\]|\*+|."


def _literal(char: Column) -> Column:
    return F.when(char.rlike(r"^[A-Za-z0-9\s]$"), char).otherwise(F.concat(F.lit("\\"), char))


def _bracket(piece: Column) -> Column:
    """A bracket as a character class in which every character is quoted."""
    negated = piece.startswith("[!")
    start = F.when(negated, 3).otherwise(2)
    inner = F.substring(piece, start, F.length(piece) - start)
    first, last = (lambda i: F.substring(i, 1, 1)), (lambda i: F.substring(i, 3, 1))
    items = F.filter(
        F.regexp_extract_all(inner, F.lit("(?s).-.|."), F.lit(0)),
        # A range from a later to an earlier character holds nothing.
        lambda i: (F.length(i) < 3) | (first(i) <= last(i)),
    )
    parts = F.transform(
        items,
        lambda i: F.when(F.length(i) == 3, F.concat(_literal(first(i)), F.lit("-"), _literal(last(i)))).otherwise(_literal(i)),
    )
    body = F.array_join(parts, "")
    return (
        F.when((body == "") & negated, ".").when(body == "", "(?!)")
        .otherwise(F.concat(F.when(negated, "[^").otherwise("["), body, F.lit("]")))
    )


def glob_to_regex(pattern: Column) -> Column:
    """A path glob as a whole-path pattern; ``**`` and ``*`` cross folders as in fnmatch.

    Any text gives a valid pattern: an unclosed bracket stands for itself, and
    what is not part of the glob syntax is quoted.
    """
    pieces = F.transform(
        F.regexp_extract_all(pattern, F.lit(_GLOB_PIECE), F.lit(0)),
        lambda p: F.when(p.startswith("[") & (F.length(p) > 1), _bracket(p))
        .when(p.startswith("*"), ".*").when(p == "?", ".").otherwise(_literal(p)),
    )
    return F.concat(F.lit("(?s)^"), F.array_join(pieces, ""), F.lit("$"))


def exclusion_steps(patterns: Column) -> Column:
    """Comma-separated globs taken apart, once for each row of settings, or null when there are none.

    A glob of stars and plain text alone is its ``parts`` between the stars; any
    other is a ``regex``.
    """
    globs = F.filter(
        F.transform(F.split(patterns, ","), lambda p: F.trim(p)), lambda p: p != ""
    )
    steps = F.transform(
        globs,
        lambda g: F.struct(
            F.when(~g.rlike(r"[?\[]"), F.split(g, r"\*+", -1)).alias("parts"),
            F.when(g.rlike(r"[?\[]"), glob_to_regex(g)).alias("regex"),
        ),
    )
    return F.when(F.size(globs) > 0, steps)


def _matches_parts(path: Column, parts: Column) -> Column:
    """Whether a path begins with the first part, ends with the last, and holds the others between in order."""
    head, tail, count = F.get(parts, 0), F.element_at(parts, -1), F.size(parts)
    free = F.length(path) - F.length(tail)

    def step(at: Column, part: Column) -> Column:
        # The leftmost place leaves most room to the parts behind; 0 stands for none.
        found = F.call_function("locate", part, path, F.greatest(at, F.lit(1)))
        return F.when((at > 0) & (found > 0), found + F.length(part)).otherwise(0)

    middle = F.aggregate(F.slice(parts, 2, F.greatest(count - 2, F.lit(0))), F.length(head) + 1, step)
    several = F.startswith(path, head) & F.endswith(path, tail) & (middle > 0) & (middle - 1 <= free)
    return F.when(count == 1, path == head).otherwise(several)


def excluded(path: Column, steps: Column) -> Column:
    """Whether any glob of ``exclusion_steps`` matches; plain globs compile nothing."""
    return F.exists(
        steps,
        lambda g: F.when(g["regex"].isNotNull(), F.regexp_like(path, g["regex"])).otherwise(_matches_parts(path, g["parts"])),
    )


def with_excluded(files: DataFrame, configs: DataFrame, path: str = "file_path") -> DataFrame:
    """Mark files that match their repository's exclude patterns in ``is_excluded``."""
    rules = configs.select(
        "repo_full_name", exclusion_steps(F.col("exclude_patterns")).alias("_excluded")
    ).filter(F.col("_excluded").isNotNull())
    joined = lookup_join(files, rules, "repo_full_name", F.col(path))
    hit = F.coalesce(excluded(F.col(path), F.col("_excluded")), F.lit(False))
    return joined.withColumn("is_excluded", hit).drop("_excluded")


def drop_excluded(files: DataFrame, configs: DataFrame, path: str = "file_path") -> DataFrame:
    """Drop files that match their repository's exclude patterns (an opt-in)."""
    return with_excluded(files, configs, path).filter(~F.col("is_excluded")).drop("is_excluded")


@reused
def _sections() -> Column:
    return unified.file_sections(F.col("diff_text"))


@reused
def _checked() -> Column:
    return unified.checked_sections(F.col("diff_text"))


@reused
def _hunk_texts() -> Column:
    return F.flatten(F.transform("hunks", unified.added_lines))


def diff_files(diffs: DataFrame, keys: tuple[str, ...] = PR_KEYS) -> DataFrame:
    """One row per changed file: keys, file_path, file_no, hunks."""
    return diffs.select(*keys, F.inline(_sections())).withColumnRenamed("path", "file_path")


def source_files(
    diffs: DataFrame,
    keys: tuple[str, ...] = PR_KEYS,
    specs: tuple[LanguageSpec, ...] = LANGUAGES,
    keep_all: bool = False,
) -> DataFrame:
    """Files some language handles; the others go before any line is looked at.

    ``keep_all`` adds ``diff_ok``, keeps a diff without such files as one row of
    null fields, and takes no files from a diff that does not parse.
    """
    handled = lambda files: F.filter(files, lambda f: language_of(f["path"], specs).isNotNull())
    if keep_all:
        checked = pin(diffs, _diff=_checked())
        rows = checked.select(*keys, F.col("_diff.ok").alias("diff_ok"), F.inline_outer(handled(F.col("_diff.files"))))
    else:
        rows = diffs.select(*keys, F.inline(handled(_sections())))
    return rows.withColumnRenamed("path", "file_path").withColumn(
        "language", language_of(F.col("file_path"), specs)
    )


def diff_lines(diffs: DataFrame, keys: tuple[str, ...] = PR_KEYS) -> DataFrame:
    """One row per body line: path, hunk, position, kind, target line, text."""
    hunks = diff_files(diffs, keys).select(
        *keys, F.col("file_path").alias("path"), F.posexplode("hunks").alias("hunk", "chunk")
    )
    return hunks.select(*keys, "path", "hunk", F.inline(unified.body_lines(F.col("chunk"))))


def added_only(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("kind") == "+")


def diff_added_lines(diffs: DataFrame, keys: tuple[str, ...] = PR_KEYS) -> DataFrame:
    """Added lines only, without listing the others first."""
    hunks = diff_files(diffs, keys).select(
        *keys, F.col("file_path").alias("path"), F.posexplode("hunks").alias("hunk", "chunk")
    )
    lines = hunks.select(*keys, "path", "hunk", F.inline(unified.added_lines(F.col("chunk"))))
    return lines.withColumn("text", F.expr("substring(text, 2)"))


def supported_files(files: DataFrame, specs: tuple[LanguageSpec, ...] = LANGUAGES) -> DataFrame:
    """Keep files some language handles, as ``source_files`` does on diff rows."""
    return files.withColumn("language", language_of(F.col("file_path"), specs)).filter(
        F.col("language").isNotNull()
    )


def added_text(files: DataFrame) -> DataFrame:
    """Replace hunks by the file's added text and the line number of each of its lines."""
    return pin(files, added=_hunk_texts()).select(
        *[c for c in files.columns if c != "hunks"],
        # Every line gives up its plus sign: the first here, the others at their line end.
        F.replace(
            F.expr("substring(array_join(added.text, '\n'), 2)"), F.lit("\n+"), F.lit("\n")
        ).alias("added_text"),
        F.col("added.line_no").alias("line_numbers"),
    )


def diff_errors(diffs: DataFrame, keys: tuple[str, ...] = PR_KEYS) -> DataFrame:
    """Keys of diffs whose hunks disagree with their headers."""
    return diffs.filter(~unified.diff_is_consistent(F.col("diff_text"))).select(
        *keys, F.lit("diff does not match its hunk headers").alias("reason")
    )


