"""Changed functions of the supported languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.functions.lexing import body_end_columns, functions_in, with_body_ends
from revlake.functions.text import newlines, reused, strip
from revlake.languages import LANGUAGES, LanguageSpec
from revlake.operators.diffs import (
    PR_KEYS, added_text, drop_excluded, source_files, with_excluded,
)


def by_language(language: Column, choose, specs: tuple[LanguageSpec, ...] = LANGUAGES) -> Column:
    """CASE over languages, so that one pass over the rows serves them all."""
    choice = None
    for spec in specs:
        value = choose(spec)
        test = language == spec.language
        choice = F.when(test, value) if choice is None else choice.when(test, value)
    return choice


def function_id(line: Column, keys: tuple[str, ...] = PR_KEYS) -> Column:
    """Stable id of a function: keys, path, signature line and name."""
    parts = [F.col(k).cast("string") for k in (*keys, "file_path")]
    return F.sha2(F.concat_ws(":", *parts, line.cast("string"), F.col("function_name")), 256)


@reused
def _found(compat: bool, specs: tuple[LanguageSpec, ...]) -> Column:
    def found(spec: LanguageSpec) -> Column:
        return functions_in(spec, F.col("added_text"), compat, chunks=F.col("_chunks"), ends=F.col("_ends"))

    return by_language(F.col("language"), found, specs)


@reused
def _passes(specs: tuple[LanguageSpec, ...]) -> tuple[Column, Column, Column]:
    return body_end_columns(lambda choose: by_language(F.col("language"), choose, specs))


def functions_of_files(
    texts: DataFrame,
    keys: tuple[str, ...] = PR_KEYS,
    line_mode: str = "true",
    compat: bool = False,
    specs: tuple[LanguageSpec, ...] = LANGUAGES,
    carry: tuple[str, ...] = (),
    keep_all: bool = False,
) -> DataFrame:
    """Functions found in ``added_text`` rows; ``carry`` names columns to keep.

    ``line_mode="true"`` gives the target line of the signature;
    ``"file_first"`` gives every function the file's first added line.
    ``compat`` lets an expression-bodied arrow take a later brace as its body.
    """
    if line_mode not in ("true", "file_first"):
        raise ValueError(f"unknown line_mode: {line_mode}")
    braces = tuple(spec for spec in specs if spec.body != "indent")
    listed = (F.inline_outer if keep_all else F.inline)(_found(compat, specs))
    if braces:
        texts = with_body_ends(texts, _passes(braces))
    rows = texts.select(*keys, *carry, "file_path", "language", "line_numbers", listed)
    source = strip(F.col("source"))
    numbers = F.col("line_numbers")
    if line_mode == "true":
        start = F.get(numbers, F.col("first_line"))
        end = F.get(numbers, F.col("first_line") + newlines(source))
    else:
        extra = F.coalesce(by_language(F.col("language"), lambda spec: F.lit(spec.lines_behind), specs), F.lit(0))
        start = F.get(numbers, F.lit(0))
        end = start + F.col("lines") + extra
    return rows.select(
        function_id(F.get(numbers, F.col("first_line")), keys).alias("function_id"),
        *keys,
        *carry,
        "file_path",
        "function_name",
        source.alias("source_code"),
        start.cast("int").alias("start_line"),
        end.cast("int").alias("end_line"),
        "language",
    )


def changed_functions(
    diffs: DataFrame,
    keys: tuple[str, ...] = PR_KEYS,
    line_mode: str = "true",
    compat: bool = False,
    configs: DataFrame | None = None,
    specs: tuple[LanguageSpec, ...] = LANGUAGES,
    carry: tuple[str, ...] = (),
    keep_all: bool = False,
) -> DataFrame:
    """Diff rows to changed functions without a shuffle.

    Pass ``configs`` to apply the repositories' exclude patterns and ``carry``
    to keep more columns of the diff rows. With ``keep_all`` a file or diff
    without functions stays as a row whose function_name is null, and
    ``diff_ok`` tells whether its diff parses, so that later counts need no
    second look at the diffs.
    """
    files = source_files(diffs, (*keys, *carry), specs, keep_all)
    carry = (*carry, "diff_ok") if keep_all else carry
    if configs is not None and keep_all:
        marked = with_excluded(files, configs)
        files = marked.withColumn("hunks", F.when(~F.col("is_excluded"), F.col("hunks")))
    elif configs is not None:
        files = drop_excluded(files, configs)
    return functions_of_files(
        added_text(files), keys, line_mode, compat, specs, carry, keep_all
    )
