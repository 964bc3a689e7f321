"""Writers of the output tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlake import schemas


def with_review_defaults(reviews: DataFrame) -> DataFrame:
    """Review rows in table order, with the stored defaults where a value is missing."""
    fallback = {name: F.lit(value) for name, value in schemas.REVIEW_DEFAULTS.items()}
    fallback["created_at"] = F.current_timestamp()

    def stored(field: T.StructField) -> Column:
        # Reviews without a key or a task of their own keep null there.
        own = F.col(field.name) if field.name in reviews.columns else F.lit(None).cast(field.dataType)
        return F.coalesce(own, fallback[field.name]).alias(field.name) if field.name in fallback else own.alias(field.name)

    return reviews.select(*[stored(field) for field in schemas.REVIEWS])


def write_batch(df: DataFrame, batch_id: int, path: str, fmt: str = "parquet") -> None:
    """Write one batch so that a replay replaces it instead of adding to it."""
    df.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")


def append_reviews(reviews: DataFrame, path: str, batch_id: int) -> None:
    """Add a batch of reviews; rebalancing gives files of even size, whatever the repositories."""
    write_batch(with_review_defaults(reviews).hint("rebalance"), batch_id, path)


def append_job_events(events: DataFrame, path: str, batch_id: int) -> None:
    write_batch(events, batch_id, path)


def append_outbox(outbox: DataFrame, path: str, batch_id: int) -> None:
    write_batch(outbox, batch_id, path)


def append_notifications(messages: DataFrame, path: str, batch_id: int) -> None:
    write_batch(messages, batch_id, path, "json")


def latest_version(df: DataFrame) -> DataFrame:
    """Rows of the highest batch_id of a table written by ``write_batch``."""
    newest = df.agg(F.max("batch_id").alias("batch_id"))
    return df.join(F.broadcast(newest), "batch_id", "left_semi").drop("batch_id")
