"""Complexity scores, ranks and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.functions.lexing import code_only, functions_in, match_arms
from revlake.functions.text import let, reused, strip
from revlake.languages import FLAGS, LANGUAGES, RANK_BANDS, LanguageSpec
from revlake.operators.extraction import by_language


def _banded(score: Column, bands) -> Column:
    choice = None
    for limit, rank in bands:
        test = score <= limit
        choice = F.when(test, rank) if choice is None else choice.when(test, rank)
    return choice.otherwise("F")


def rank_of(
    score: Column, language: Column | None = None, specs: tuple[LanguageSpec, ...] = LANGUAGES
) -> Column:
    """Rank by the bands of the language's record, or by the common ones."""
    plain = _banded(score, RANK_BANDS)
    own = tuple(s for s in specs if s.rank_bands != RANK_BANDS)
    if language is None or not own:
        return plain
    return F.coalesce(by_language(language, lambda s: _banded(score, s.rank_bands), own), plain)


def score_of(spec: LanguageSpec, source: Column) -> Column:
    """1 + weighted branch tokens outside literals (+ match arms in Rust)."""

    def count(code: Column) -> Column:
        total = F.lit(1)
        for pattern, weight in spec.branch_rules:
            total = total + F.regexp_count(code, F.lit(FLAGS + pattern)) * F.lit(weight)
        return total + match_arms(code) if spec.match_arms else total

    code = code_only(spec, source)
    if spec.lexed_head:
        code = F.regexp_extract(code, r"(?s)\{.*", 0)
    return let(code, count)


def _result(name: Column, score: Column) -> Column:
    return F.struct(name.alias("result_name"), score.cast("int").alias("score"))


def _named_results(spec: LanguageSpec, source: Column) -> Column:
    """A result per function of a source; inner functions only where a language lists them."""
    return F.transform(
        functions_in(spec, source, nested=spec.lists_inner),
        lambda f: _result(f["function_name"], score_of(spec, strip(f["source"]))),
    )


def _flag(rows: DataFrame, threshold: Column) -> DataFrame:
    score = F.col("score")
    return rows.withColumn("rank", rank_of(score, F.col("language"))).withColumn(
        "is_flagged", score > threshold
    )


@reused
def _source_results(specs: tuple[LanguageSpec, ...]) -> Column:
    return by_language(
        F.col("language"), lambda spec: _named_results(spec, F.col("source_code")), specs
    )


def analyze_sources(
    sources: DataFrame, threshold: Column | int, specs: tuple[LanguageSpec, ...] = LANGUAGES
) -> DataFrame:
    """Results for rows of (language, source_code); an unknown language gives none."""
    rows = sources.select("*", F.posexplode(_source_results(specs)).alias("result_no", "_r"))
    rows = rows.select(*sources.columns, "result_no", "_r.result_name", "_r.score")
    return _flag(rows, F.lit(threshold) if isinstance(threshold, int) else threshold)


@reused
def _function_results(specs: tuple[LanguageSpec, ...]) -> Column:
    def results(spec: LanguageSpec) -> Column:
        source = F.col("source_code")
        whole = F.array(_result(F.col("function_name"), score_of(spec, source)))
        if not spec.lists_inner:
            return whole
        signatures = F.regexp_count(source, F.lit(FLAGS + spec.plain_signature))
        return F.when(signatures > 1, _named_results(spec, source)).otherwise(whole)

    return F.when(F.col("function_name").isNotNull(), by_language(F.col("language"), results, specs))


def score_functions(
    functions: DataFrame, specs: tuple[LanguageSpec, ...] = LANGUAGES, keep_all: bool = False
) -> DataFrame:
    """Results for extracted functions, before any threshold is known.

    An extracted function is its own only outermost function, so it is scored
    without being searched again, unless its language lists inner functions too.
    """
    listed = (F.posexplode_outer if keep_all else F.posexplode)(_function_results(specs))
    exploded = functions.select("*", listed.alias("result_no", "_r"))
    rows = exploded.select(*functions.columns, "result_no", "_r.result_name", "_r.score")
    return rows.withColumn(
        "rank", F.when(F.col("score").isNotNull(), rank_of(F.col("score"), F.col("language")))
    )


def go_with_package(source: Column) -> Column:
    """Go source with a package clause, as its tools require."""
    return F.when(source.rlike(r"^\s*package\s+\w+"), source).otherwise(
        F.concat(F.lit("package main\n"), source)
    )
