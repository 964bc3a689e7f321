"""Readers of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlake import schemas


def read_diff_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed diffs, one file per PR at ``…/<owner>/<repo>/<number>.diff``."""
    key = r"/([^/]+/[^/]+)/(\d+)\.diff$"
    source = F.col("_metadata.file_path")
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.diff")
    return rows.select(
        F.regexp_extract(source, key, 1).alias("repo_full_name"),
        F.regexp_extract(source, key, 2).try_cast("bigint").alias("pr_number"),
        F.lit("").alias("pr_title"),
        F.col("value").alias("diff_text"),
    )


def read_landed_diffs(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Landed diff files with the task each was fetched for, whatever their names.

    ``manifest`` has a row for each file: ``file_path`` as Spark names it, and
    ``task_id``. A file that it doesn't name is not read into a run, and a file
    named for several tasks is read for each. The texts don't move for the join
    while the manifest is within the broadcast limit.
    """
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    files = rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("diff_text"))
    return files.join(manifest.select("file_path", "task_id"), "file_path").select("task_id", "diff_text")


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schema).load(path)


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.DIFFS)


def read_deliveries(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.DELIVERIES)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.JOBS)


def read_job_events(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.JOB_EVENTS)


def read_repo_configs(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.REPO_CONFIGS)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of all batches."""
    return read_table(spark, path, schemas.REVIEWS).select(*schemas.REVIEWS.names)


def read_scan_reports(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.SCAN_REPORTS)


def read_triage_responses(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.TRIAGE_RESPONSES)


def read_pr_comments(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.PR_COMMENTS)


def read_database_table(
    spark: SparkSession,
    url: str,
    name: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 32,
    **options: str,
) -> DataFrame:
    """An existing application table over JDBC, read in ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return reader.load()


# Rows of a narrow table that one task takes through text work.
SPREAD_ROWS = 20_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a stored table whose splits would leave cores idle or one task with most rows.

    Text work is bound by the processor. Splits tell little: a file of one row
    group is read whole by one of them. So rows are counted, which reads no
    column, and dealt to a number of tasks that grows with them. A table of few
    rows a split that keeps a quarter of the cores busy is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows, splits = df.count(), df.rdd.getNumPartitions()
    if splits * 4 > cores and rows <= splits * SPREAD_ROWS // 4:
        return df
    return df.repartition(max(cores, -(-rows // SPREAD_ROWS)), *keys)
