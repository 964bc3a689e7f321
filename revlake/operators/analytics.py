"""Dashboard figures over reviews. ``newest`` restricts to the latest rows first."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.functions.text import basename, blank_to_null, half_up
from revlake.operators.listing import newest_first

# Rows the dashboard pages show, buckets and display fallbacks.
ANALYTICS_NEWEST, FEED_NEWEST, TOP_FILES = 100, 50, 10
BUCKETS = ("Critical", "High", "Medium", "Low")
EXACT_BUCKETS = ("High", "Medium", "Low")
STATUS_ICONS = {"pending": "clock", "posted": "check", "error": "alert"}
JOB_STATUSES = ("queued", "processing", "complete", "failed")
UNKNOWN = "unknown"


def newest_rows(reviews: DataFrame, newest: int | None) -> DataFrame:
    return reviews if newest is None else newest_first(reviews).limit(newest)


def _priority(exact_case: bool) -> Column:
    return F.col("priority") if exact_case else F.initcap("priority")


def _score() -> Column:
    return F.coalesce(F.col("complexity_score"), F.lit(0.0))


def dashboard_stats(
    reviews: DataFrame, newest: int | None = None, exact_case: bool = False
) -> DataFrame:
    """Total, average complexity (a dash when there are no rows), high and posted counts."""
    average = half_up(F.sum(_score()) / F.count("*"), 1)
    return newest_rows(reviews, newest).agg(
        F.count("*").alias("total_reviews"),
        F.when(F.count("*") > 0, F.format_string("%.1f", average)).otherwise("—").alias("avg_complexity"),
        F.count_if(_priority(exact_case) == "High").alias("high_priority"),
        F.count_if(F.col("status") == "posted").alias("posted"),
    )


def priority_breakdown(
    reviews: DataFrame, newest: int | None = None, exact_case: bool = False
) -> DataFrame:
    """Count and rounded percentage per priority bucket, zero for an empty one."""
    buckets = EXACT_BUCKETS if exact_case else BUCKETS
    counted = newest_rows(reviews, newest).agg(
        F.count("*").alias("total"),
        *[F.count_if(_priority(exact_case) == b).alias(b) for b in buckets],
    )
    share = lambda b: F.when(
        F.col("total") > 0, half_up(F.lit(100.0) * F.col(b) / F.col("total"))
    ).otherwise(0)
    rows = [
        F.struct(F.lit(b).alias("priority"), F.col(b).alias("reviews"), share(b).cast("bigint").alias("percent"))
        for b in buckets
    ]
    return counted.select(F.inline(F.array(*rows)))


def complexity_trend(reviews: DataFrame, newest: int | None = None) -> DataFrame:
    """Reviews and average complexity per day, oldest first."""
    day = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit(UNKNOWN))
    return (
        newest_rows(reviews, newest)
        .groupBy(day.alias("date"))
        .agg(
            F.count("*").alias("reviews"),
            half_up(F.sum(_score()) / F.count("*"), 1).alias("avg_complexity"),
        )
        .orderBy("date")
    )


def top_files(reviews: DataFrame, newest: int | None = None, limit: int = TOP_FILES) -> DataFrame:
    """Files with most reviews, by base name."""
    name = F.coalesce(blank_to_null(basename(F.col("file_path"))), F.lit(UNKNOWN))
    return (
        newest_rows(reviews, newest)
        .groupBy(name.alias("file"))
        .agg(F.count("*").alias("reviews"))
        .orderBy(F.col("reviews").desc(), "file")
        .limit(limit)
    )


def activity_heatmap(reviews: DataFrame) -> DataFrame:
    """Reviews per weekday (1 = Sunday) and hour."""
    dated = reviews.filter(F.col("created_at").isNotNull())
    return dated.groupBy(
        F.dayofweek("created_at").alias("weekday"), F.hour("created_at").alias("hour")
    ).agg(F.count("*").alias("reviews"))


def pr_cards(
    reviews: DataFrame,
    repo: str | None = None,
    since: date | None = None,
    until: date | None = None,
    severity: str | None = None,
) -> DataFrame:
    """One card per PR: flagged functions, top complexity and latest status."""
    if repo:
        reviews = reviews.filter(F.col("repo_full_name") == repo)
    if since:
        reviews = reviews.filter(F.col("created_at") >= F.lit(since))
    if until:
        reviews = reviews.filter(F.col("created_at") < F.date_add(F.lit(until), 1))
    if severity:
        reviews = reviews.filter(F.lower("priority") == severity.lower())
    return reviews.groupBy("repo_full_name", "pr_number").agg(
        F.max_by("pr_title", F.struct("created_at", "id")).alias("pr_title"),
        F.count("*").alias("flagged_functions"),
        F.max("complexity_score").alias("top_complexity"),
        F.max_by("status", F.struct("created_at", "id")).alias("status"),
    )


def priority_class(priority: Column) -> Column:
    return F.when(priority.isin(*EXACT_BUCKETS), priority).otherwise("Low")


def status_icon(status: Column) -> Column:
    icons = F.create_map(*[F.lit(x) for pair in STATUS_ICONS.items() for x in pair])
    return F.coalesce(F.try_element_at(icons, status), F.lit(STATUS_ICONS["pending"]))


def job_class(status: Column) -> Column:
    return F.when(status.isin(*JOB_STATUSES), status).otherwise(JOB_STATUSES[0])


def feed_rows(reviews: DataFrame, newest: int | None = FEED_NEWEST) -> DataFrame:
    """Feed lines: title, place, priority class and status icon."""
    line = F.col("line_number")
    place = F.concat(
        F.coalesce(F.col("file_path"), F.lit("")),
        F.when(line != 0, F.concat(F.lit(":"), line.cast("string"))).otherwise(""),
    )
    return newest_rows(reviews, newest).select(
        "id",
        F.col("repo_full_name").alias("repo"),
        "pr_number",
        F.coalesce(blank_to_null(F.col("function_name")), F.col("pr_title")).alias("title"),
        place.alias("place"),
        priority_class(F.col("priority")).alias("priority_class"),
        status_icon(F.col("status")).alias("status_icon"),
    )
