"""Paged lists and single rows, as the API returns them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page sizes.
REVIEW_PAGE, JOB_PAGE, MAX_PAGE = 50, 20, 100


@dataclass(frozen=True)
class Page:
    total: DataFrame  # one row: total
    rows: DataFrame

    def with_total(self) -> DataFrame:
        """Page rows carrying the total; an empty page is one row of the total and nulls."""
        return self.total.join(self.rows, F.lit(True), "left")


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 text; fractions appear only when there are any."""
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == ".000000", "").otherwise(fraction)
    )


def review_view(reviews: DataFrame) -> DataFrame:
    return reviews.select(
        "id",
        F.col("repo_full_name").alias("repo"),
        "pr_number", "pr_title", "function_name", "file_path", "line_number",
        F.col("complexity_score").cast("int").alias("complexity_score"),
        "suggestion", "priority", "status",
        iso_timestamp(F.col("created_at")).alias("created_at"),
    )


def job_view(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "id", "celery_task_id", F.col("repo_full_name").alias("repo"), "pr_number", "status",
        "error_message", iso_timestamp(F.col("created_at")).alias("created_at"),
    )


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc())


def behind(rows: DataFrame, created_at: Column, row_id: int) -> DataFrame:
    """Rows that follow the one of a time and id in the order of lists; times that are null come last."""
    at, number = F.col("created_at"), F.col("id")
    older = F.when(created_at.isNull(), at.isNull() & (number < row_id)).otherwise(
        at.isNull() | (at < created_at) | ((at == created_at) & (number < row_id))
    )
    return rows.filter(older)


#: Rows of a list that may share a range of times or ids before it is divided further, and its parts.
RANGE_ROWS, RANGE_PARTS = 10_000, 1024


def _range_at(rows: DataFrame, key: Column, low: int, high: int, skip: int) -> tuple[int, int, int]:
    """Of keys from ``low`` to ``high``, descending: the range that holds the row at ``skip``, and its place in it.

    Each step counts the rows of at most RANGE_PARTS equal ranges and goes on in one of them.
    """
    while low < high:
        width = -(-(high - low + 1) // RANGE_PARTS)
        inside = rows.filter(key.between(low, high))
        # Decimals: the keys may lie further apart than a bigint tells.
        whole = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("decimal(20,0)")
        part = F.call_function("div", whole(key) - whole(low), whole(width))
        counts = {r["part"]: r["count"] for r in inside.groupBy(part.alias("part")).count().collect()}
        for number in sorted(counts, reverse=True):
            if skip < counts[number]:
                break
            skip -= counts[number]
        low, high = low + number * width, min(high, low + (number + 1) * width - 1)
        if counts[number] <= RANGE_ROWS:
            break
    return low, high, skip


def deep_offset(rows: DataFrame, skip: int) -> tuple[DataFrame, int]:
    """The rows of a newest-first list from a place at or before ``skip`` on, and how many of them to skip still.

    What is left to skip is RANGE_ROWS at most, unless more rows than that have
    one time and one id. Counts of ranges of times, then of ids, find the place;
    no task keeps the rows before it.
    """
    at = F.unix_micros("created_at")
    timed, bare = rows.filter(F.col("created_at").isNotNull()), rows.filter(F.col("created_at").isNull())
    ends = timed.agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n")).first()
    number = F.col("id")

    def by_id(same: DataFrame, left: int) -> tuple[int, int] | None:
        found = same.agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count("*").alias("n")).first()
        if left >= found["n"]:
            return None
        _, top, left = _range_at(same, number, found["low"], found["high"], left)
        return top, left

    if skip >= ends["n"]:  # times that are null come last
        place = by_id(bare, skip - ends["n"])
        return (bare.filter(number <= place[0]), place[1]) if place else (rows.limit(0), 0)
    low, high, left = _range_at(timed, at, ends["low"], ends["high"], skip)
    upper = F.timestamp_micros(F.lit(high))
    if low < high or left <= RANGE_ROWS:
        return rows.filter(F.col("created_at").isNull() | (F.col("created_at") <= upper)), left
    top, left = by_id(timed.filter(F.col("created_at") == upper), left)
    behind_it = F.col("created_at").isNull() | (F.col("created_at") < upper) | ((F.col("created_at") == upper) & (number <= top))
    return rows.filter(behind_it), left


def _page(
    rows: DataFrame, repo: str | None, status: str | None, skip: int, limit: int, view,
    after: tuple[Column, int] | None = None,
) -> Page:
    if skip < 0:
        raise ValueError("skip must be at least 0")
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    if repo:
        rows = rows.filter(F.col("repo_full_name") == repo)
    if status:
        rows = rows.filter(F.col("status") == status)
    total = rows.agg(F.count("*").alias("total"))
    found = rows if after is None else behind(rows, *after)
    # A top-k plan makes one task keep all rows before its offset.
    found, skip = deep_offset(found, skip) if skip > RANGE_ROWS else (found, skip)
    return Page(total, view(newest_first(found).offset(skip).limit(limit)))


def list_reviews(
    reviews: DataFrame, repo: str | None = None, status: str | None = None,
    skip: int = 0, limit: int = REVIEW_PAGE, after: tuple[Column, int] | None = None,
) -> Page:
    """A page of reviews; ``after`` (time and id of the last row seen) goes on from there without an offset."""
    return _page(reviews, repo, status, skip, limit, review_view, after)


def list_jobs(
    jobs: DataFrame, repo: str | None = None, status: str | None = None,
    skip: int = 0, limit: int = JOB_PAGE, after: tuple[Column, int] | None = None,
) -> Page:
    return _page(jobs, repo, status, skip, limit, job_view, after)


def get_review(reviews: DataFrame, review_id: int) -> DataFrame:
    """The review with an id; no row means not found."""
    return review_view(reviews.filter(F.col("id") == review_id))
