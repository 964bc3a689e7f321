"""Comment texts, superseded comments and the comment outbox."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.operators.diffs import PR_KEYS


@dataclass(frozen=True)
class CommentStyle:
    """Names a site puts on its comments; markers are built from the slug."""

    brand: str = "revlake"
    slug: str = "revlake"

    @property
    def all_clear_marker(self) -> str:
        return f"<!-- {self.slug}:all-clear -->"

    @property
    def nothing_to_scan_marker(self) -> str:
        return f"<!-- {self.slug}:nothing-to-scan -->"


STYLE = CommentStyle()

# Emoji per severity and the fixed sentences of the comments.
SEVERITY_EMOJI = {"critical": "🚨", "high": "🔴"}
OTHER_EMOJI = "🟡"
REVIEW_FOOTER = (
    "\n---\n*{brand} triages production risks only — style and complexity feedback is "
    "intentionally filtered out.*"
)
ALL_CLEAR_HEAD = "{marker}\n## ✓ {brand} — No production risks found\n\n"
ALL_CLEAR_BODY = (
    ". All within acceptable complexity, no security / crash / data-loss / concurrency / "
    "correctness concerns flagged.\n\n"
)
ALL_CLEAR_FOOTER = (
    "---\n*{brand} flags only production-risk findings; style and complexity feedback is "
    "intentionally filtered out. Disable per-repo in Settings if the acknowledgement is noise.*"
)
NOTHING_HEAD = "{marker}\n## ⊘ {brand} — Nothing to scan\n\n"
NOTHING_CHANGED = (
    "No function-level changes were detected in this PR — the diff may contain only docs, "
    "config, assets, or unsupported file types. No analysis was run."
)
NOTHING_COMPLEX = (
    ", but none exceeded the complexity threshold for deeper review. No LLM triage was run."
)
NOTHING_FOOTER = (
    "\n\n---\n*{brand} only scans functions that static analysis flags as sufficiently complex "
    "or risky. Adjust the per-repo complexity threshold in Settings if you'd like broader "
    "coverage.*"
)


def severity_emoji(severity: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SEVERITY_EMOJI.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(severity)), F.lit(OTHER_EMOJI))


def issue_label(issue_type: Column) -> Column:
    return F.initcap(F.replace(issue_type, F.lit("_"), F.lit(" ")))


def function_noun(count: Column) -> Column:
    return F.when(count == 1, "function").otherwise("functions")


def review_comment(
    function_name: Column,
    language: Column,
    severity: Column,
    issue_type: Column,
    summary: Column,
    suggested_fix: Column,
    explanation: Column,
    security_issues: Column,
    style: CommentStyle = STYLE,
) -> Column:
    """Markdown of a finding, with optional fix and scanner blocks."""
    fix = F.when(
        suggested_fix != "",
        F.concat(F.lit("\n### Suggested fix\n```"), language, F.lit("\n"), suggested_fix, F.lit("\n```\n")),
    )
    flags = F.when(
        F.size(security_issues) > 0,
        F.concat(
            F.lit("\n### Static scanner flags\n"),
            F.array_join(F.transform(security_issues, lambda i: F.concat(F.lit("- "), i, F.lit("\n"))), ""),
        ),
    )
    return F.concat(
        F.lit("## "), severity_emoji(severity), F.lit(f" {style.brand} — "), issue_label(issue_type),
        F.lit(" ("), F.upper(severity), F.lit(")\n\n**Function**: `"), function_name,
        F.lit("`\n\n### What could go wrong\n"), summary,
        F.lit("\n\n### Why\n"), explanation, F.lit("\n"),
        F.coalesce(fix, F.lit("")),
        F.coalesce(flags, F.lit("")),
        F.lit(REVIEW_FOOTER.format(brand=style.brand)),
    )


def language_breakdown(counts: Column) -> Column:
    """`` (go: 2, python: 1)`` from (language, n) structs; empty when there are none."""
    parts = F.transform(
        F.array_sort(counts), lambda c: F.concat(c["language"], F.lit(": "), c["n"].cast("string"))
    )
    return F.when(
        F.size(counts) > 0, F.concat(F.lit(" ("), F.array_join(parts, ", "), F.lit(")"))
    ).otherwise("")


def all_clear_comment(analyzed: Column, breakdown: Column, style: CommentStyle = STYLE) -> Column:
    return F.concat(
        F.lit(ALL_CLEAR_HEAD.format(marker=style.all_clear_marker, brand=style.brand)),
        F.lit("Reviewed "), analyzed.cast("string"), F.lit(" "), function_noun(analyzed), breakdown,
        F.lit(ALL_CLEAR_BODY), F.lit(ALL_CLEAR_FOOTER.format(brand=style.brand)),
    )


def nothing_to_scan_comment(function_count: Column, style: CommentStyle = STYLE) -> Column:
    detail = F.when(function_count == 0, NOTHING_CHANGED).otherwise(
        F.concat(
            F.lit("Found "), function_count.cast("string"), F.lit(" changed "),
            function_noun(function_count), F.lit(NOTHING_COMPLEX),
        )
    )
    return F.concat(
        F.lit(NOTHING_HEAD.format(marker=style.nothing_to_scan_marker, brand=style.brand)),
        detail,
        F.lit(NOTHING_FOOTER.format(brand=style.brand)),
    )


def superseded_comments(
    comments: DataFrame, acknowledged: DataFrame, style: CommentStyle = STYLE
) -> DataFrame:
    """Earlier comments that a fresh acknowledgement replaces.

    ``acknowledged`` holds PR_KEYS and ``kind``, one row per PR. Only comments
    that carry a marker reach the join, each under the kind of its marker.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    kinds = F.filter(
        F.array(
            F.when(body.contains(style.all_clear_marker), "all_clear"),
            F.when(body.contains(style.nothing_to_scan_marker), "nothing_to_scan"),
        ),
        lambda k: k.isNotNull(),
    )
    marked = comments.select(*PR_KEYS, "comment_id", F.explode(kinds).alias("kind"))
    hits = marked.join(acknowledged.select(*PR_KEYS, "kind"), [*PR_KEYS, "kind"], "left_semi")
    # An acknowledgement is of one kind, so a comment is hit at most once.
    return hits


def deleted_counts(superseded: DataFrame) -> DataFrame:
    return superseded.groupBy(*PR_KEYS).agg(F.count("*").alias("deleted"))


def surviving_comments(comments: DataFrame, superseded: DataFrame) -> DataFrame:
    return comments.join(superseded.select("comment_id"), "comment_id", "left_anti")


def latest_commits(commits: DataFrame) -> DataFrame:
    """The last commit of each PR from (PR_KEYS, commit_seq, commit_sha)."""
    return commits.groupBy(*PR_KEYS).agg(F.max_by("commit_sha", "commit_seq").alias("commit_sha"))
