"""Webhook deliveries to jobs, and job state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake import schemas
from revlake.functions.signing import signature_is_valid
from revlake.functions.strict_json import is_json
from revlake.functions.text import pin

# The actions that start a run.
RUN_ACTIONS = ("opened", "synchronize")

UNAUTHORIZED, MALFORMED, IGNORED, INVALID, ENQUEUED = (
    "unauthorized", "malformed", "ignored", "invalid", "enqueued",
)
HTTP_STATUS = {UNAUTHORIZED: 401, MALFORMED: 500, IGNORED: 200, INVALID: 400, ENQUEUED: 200}


def verified(deliveries: DataFrame, secret: str) -> DataFrame:
    return deliveries.withColumn(
        "is_authentic", signature_is_valid(F.col("body"), F.col("signature"), secret)
    )


def _payload_fields(payload: Column) -> dict[str, Column]:
    return {
        "action": payload["action"],
        "repo_full_name": payload["repository"]["full_name"],
        "pr_number": payload["pull_request"]["number"],
        "pr_title": F.coalesce(payload["pull_request"]["title"], F.lit("")),
        "installation_id": payload["installation"]["id"],
    }


def classified(deliveries: DataFrame, secret: str) -> DataFrame:
    """Deliveries with payload fields and their disposition."""
    opened = verified(deliveries, secret).withColumn(
        "_payload", F.from_json(F.col("body"), schemas.WEBHOOK_PAYLOAD)
    )
    rows = pin(opened, **_payload_fields(F.col("_payload"))).drop("_payload")
    present = (
        (F.col("repo_full_name") != "") & (F.col("pr_number") != 0) & (F.col("installation_id") != 0)
    )
    unread = ~is_json(F.col("body"))
    disposition = (
        F.when(~F.col("is_authentic"), UNAUTHORIZED)
        .when(unread, MALFORMED)
        .when(F.coalesce(~F.col("action").isin(*RUN_ACTIONS), F.lit(True)), IGNORED)
        .when(~F.coalesce(present, F.lit(False)), INVALID)
        .otherwise(ENQUEUED)
    )
    return rows.withColumn("disposition", disposition)


def disposition_counts(deliveries: DataFrame, secret: str) -> DataFrame:
    return classified(deliveries, secret).groupBy("disposition").agg(F.count("*").alias("deliveries"))


def jobs_from_deliveries(deliveries: DataFrame, secret: str) -> DataFrame:
    """A queued job per accepted delivery; ids repeat exactly on a replay."""
    accepted = classified(deliveries, secret).filter(F.col("disposition") == ENQUEUED)
    task_id = F.sha2(F.col("delivery_id").cast("string"), 256)
    return accepted.select(
        F.xxhash64(task_id).alias("id"),
        task_id.alias("celery_task_id"),
        "repo_full_name",
        "pr_number",
        "pr_title",
        "installation_id",
        F.lit(schemas.JOB_STATUS_DEFAULT).alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.col("received_at").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def current_jobs(job_events: DataFrame) -> DataFrame:
    """Latest state of each job from its event log."""
    order = F.struct("ts", "seq")
    return job_events.groupBy("task_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by(F.struct("error_message"), order)["error_message"].alias("error_message"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.count("*").alias("events"),
    )


def jobs_by_task(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Jobs of the given (task_id) rows; a task without a job keeps null fields."""
    return tasks.join(jobs.withColumnRenamed("celery_task_id", "task_id"), "task_id", "left")
