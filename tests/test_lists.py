from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from revlake import schemas
from revlake.operators import analytics as A
from revlake.operators import listing as Q
from revlake.sources import readers, sinks, staging


def review(id, repo="o/r", score=5.0, priority="Low", status="pending", created=datetime(2024, 3, 1, 10), **fields):
    row = {name: None for name in schemas.REVIEWS.names}
    row.update(id=id, repo_full_name=repo, pr_number=1, pr_title="t", complexity_score=score,
               priority=priority, status=status, created_at=created, **fields)
    return tuple(row[n] for n in schemas.REVIEWS.names)


def reviews(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.REVIEWS)


def test_empty_list(spark):
    page = Q.list_reviews(reviews(spark))
    assert page.total.first().total == 0 and page.rows.count() == 0
    stats = A.dashboard_stats(reviews(spark)).first()
    assert (stats.total_reviews, stats.avg_complexity) == (0, "—")
    assert {r.percent for r in A.priority_breakdown(reviews(spark)).collect()} == {0}


def test_pages_are_newest_first(spark):
    same = datetime(2024, 3, 1, 10)
    table = reviews(
        spark, review(1, created=same), review(3, created=same), review(2, created=None),
        review(4, created=datetime(2024, 3, 1, 10, 0, 0, 5000)), review(5, repo="o/x", status="posted"),
    )
    page = Q.list_reviews(table, repo="o/r", status="")
    assert [r.id for r in page.rows.collect()] == [4, 3, 1, 2]
    assert page.total.first().total == 4
    shown = page.rows.first()
    assert (shown.repo, shown.complexity_score, shown.created_at) == ("o/r", 5, "2024-03-01T10:00:00.005000")
    assert [r.id for r in Q.list_reviews(table, skip=1, limit=2).rows.collect()] == [5, 3]
    assert [r.id for r in Q.list_reviews(table, status="posted").with_total().collect()] == [5]


@pytest.mark.parametrize("bounds", [{"skip": -1}, {"limit": 0}, {"limit": 101}])
def test_page_bounds(spark, bounds):
    with pytest.raises(ValueError):
        Q.list_reviews(reviews(spark), **bounds)


def test_get_review(spark):
    table = reviews(spark, review(1, score=None))
    row = Q.get_review(table, 1).first()
    assert row.repo == "o/r" and row.complexity_score is None and row.file_path is None
    assert Q.get_review(table, 2).count() == 0


def test_job_list(spark):
    jobs = spark.createDataFrame(
        [(1, "t", "o/r", 3, "failed", "boom", datetime(2024, 1, 1), None, None, None)], schemas.JOBS
    )
    row = Q.list_jobs(jobs, repo="o/r").rows.first()
    assert (row.celery_task_id, row.repo, row.error_message, row.created_at) == ("t", "o/r", "boom", "2024-01-01T00:00:00")


def test_dashboard(spark):
    table = reviews(
        spark, review(1, score=2.0, priority="High", status="posted"), review(2, score=None, priority="high"),
        review(3, score=4.75, priority="Medium"), review(4, score=2.25, priority=None),
    )
    stats = A.dashboard_stats(table).first()
    assert (stats.total_reviews, stats.avg_complexity, stats.high_priority, stats.posted) == (4, "2.3", 2, 1)
    assert A.dashboard_stats(table, exact_case=True).first().high_priority == 1
    assert A.dashboard_stats(table, newest=2).first().total_reviews == 2
    shares = {r.priority: (r.reviews, r.percent) for r in A.priority_breakdown(table).collect()}
    assert shares == {"Critical": (0, 0), "High": (2, 50), "Medium": (1, 25), "Low": (0, 0)}


def test_charts(spark):
    table = reviews(
        spark,
        review(1, file_path="a/x.py", created=datetime(2024, 3, 3, 23)),
        review(2, file_path="b/x.py", score=8.0, created=datetime(2024, 3, 3, 1)),
        review(3, file_path=None, created=None),
        review(4, file_path="y.py", created=datetime(2024, 3, 4, 1)),
    )
    assert [(r.file, r.reviews) for r in A.top_files(table).collect()] == [("x.py", 2), ("unknown", 1), ("y.py", 1)]
    assert [(r.date, r.reviews, r.avg_complexity) for r in A.complexity_trend(table).collect()] == [
        ("2024-03-03", 2, 6.5), ("2024-03-04", 1, 5.0), ("unknown", 1, 5.0),
    ]
    assert {(r.weekday, r.hour, r.reviews) for r in A.activity_heatmap(table).collect()} == {
        (1, 23, 1), (1, 1, 1), (2, 1, 1),
    }


def test_cards_and_feed(spark):
    table = reviews(
        spark,
        review(1, score=3.0, status="posted", created=datetime(2024, 3, 1), function_name="f", file_path="a.py", line_number=4),
        review(2, score=9.0, status="error", priority="critical", created=datetime(2024, 3, 5), function_name=""),
        review(3, repo="o/z", status="odd", created=datetime(2024, 3, 2), file_path="b.py", line_number=0),
    )
    cards = {r.repo_full_name: r for r in A.pr_cards(table).collect()}
    assert (cards["o/r"].flagged_functions, cards["o/r"].top_complexity, cards["o/r"].status) == (2, 9.0, "error")
    assert A.pr_cards(table, repo="o/r", until=date(2024, 3, 1)).first().flagged_functions == 1
    assert A.pr_cards(table, since=date(2024, 3, 3)).count() == 1
    assert A.pr_cards(table, severity="Critical").first().flagged_functions == 1
    feed = {r.id: (r.title, r.place, r.priority_class, r.status_icon) for r in A.feed_rows(table).collect()}
    assert feed == {
        1: ("f", "a.py:4", "Low", "check"), 2: ("t", "", "Low", "alert"), 3: ("t", "b.py", "Low", "clock"),
    }
    classes = spark.createDataFrame([("failed",), ("odd",), (None,)], "s string").select(A.job_class(F.col("s")).alias("c"))
    assert [r.c for r in classes.collect()] == ["failed", "queued", "queued"]


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "diffs" / "org" / "app"
    folder.mkdir(parents=True)
    (folder / "12.diff").write_text("--- a/x.py\n+++ b/x.py\n@@ -0,0 +1 @@\n+x\n")
    (folder / "note.txt").write_text("no")
    (row,) = readers.read_diff_files(spark, str(tmp_path / "diffs")).collect()
    assert (row.repo_full_name, row.pr_number) == ("org/app", 12) and row.diff_text.endswith("+x\n")
    bare = sinks.with_review_defaults(reviews(spark, review(9, priority=None, status=None, created=None))).first()
    assert (bare.priority, bare.status) == ("Medium", "pending") and bare.created_at is not None
    table = reviews(spark, review(1), review(2, repo="o/x"))
    path = str(tmp_path / "reviews")
    for batch in (0, 1, 1):  # the second batch comes twice
        sinks.append_reviews(table, path, batch)
    assert readers.read_reviews(spark, path).groupBy("repo_full_name").count().count() == 2
    assert readers.read_reviews(spark, path).count() == 4
    for write in (sinks.append_job_events, sinks.append_outbox, sinks.append_notifications):
        write(table, str(tmp_path / write.__name__), 7)
        write(table, str(tmp_path / write.__name__), 7)
        fmt = "json" if "notifications" in write.__name__ else "parquet"
        assert spark.read.format(fmt).load(str(tmp_path / write.__name__)).count() == 2
    batches = str(tmp_path / "batches")
    sinks.write_batch(table, 0, batches)
    sinks.write_batch(table.filter("id = 1"), 1, batches)
    sinks.write_batch(table.filter("id = 1"), 1, batches)
    assert sinks.latest_version(spark.read.parquet(batches)).count() == 1
    staged = staging.stage(table, "t")
    assert staged.count() == 2 and staged.schema == table.schema
    assert staging.shared_folder(spark).rstrip("/") in staged.inputFiles()[0]


def test_only_tables_with_few_splits_are_spread(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "many"))
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    many, one = spark.read.parquet(str(tmp_path / "many")), spark.read.parquet(str(tmp_path / "one"))
    assert readers.spread(many) is many
    assert readers.spread(one).rdd.getNumPartitions() == 8 and readers.spread(one).count() == 100
