"""Repository configuration: run lookup, API reads and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake import schemas
from revlake.operators.joins import lookup_join

FIELDS = tuple(schemas.CONFIG_ROW_DEFAULTS)


def _typed(name: str, value) -> Column:
    return F.lit(value).cast(schemas.REPO_CONFIGS[name].dataType)


def _with_defaults(
    rows: DataFrame, configs: DataFrame, defaults: dict, spread_by: Column
) -> DataFrame:
    """Left join on the repository; a row's own values win, even null ones."""
    found = configs.select(
        "repo_full_name", F.struct(*defaults, F.lit(True).alias("_found")).alias("_config")
    )
    joined = lookup_join(rows, found, "repo_full_name", spread_by)
    own = F.col("_config")
    return joined.select(
        *rows.columns,
        *[
            F.when(own.isNotNull(), own[name]).otherwise(_typed(name, value)).alias(name)
            for name, value in defaults.items()
        ],
    )


def with_run_config(rows: DataFrame, configs: DataFrame, spread_by: Column) -> DataFrame:
    """Settings used by a run; repositories without a row get the run defaults."""
    return _with_defaults(rows, configs, schemas.RUN_CONFIG_DEFAULTS, spread_by)


def read_configs(repos: DataFrame, configs: DataFrame) -> DataFrame:
    """Settings as the API shows them for (repo_full_name) rows."""
    keys = repos.select("repo_full_name")
    shown = _with_defaults(keys, configs, schemas.CONFIG_API_DEFAULTS, F.col("repo_full_name"))
    return shown.withColumnRenamed("repo_full_name", "repo")


def repo_name(owner: Column, name: Column) -> Column:
    return F.concat(owner, F.lit("/"), name)


def latest_patch(patches: DataFrame) -> DataFrame:
    """Fold patches (repo_full_name, seq, fields…) to the last non-null value per field."""
    last = [
        F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in FIELDS
    ]
    return patches.groupBy("repo_full_name").agg(*last)


def upsert_configs(configs: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply patches: create missing rows with defaults, overwrite non-null fields only."""
    current = configs.select(
        "repo_full_name", F.struct(*FIELDS, F.lit(True).alias("_found")).alias("_cur")
    )
    patch = latest_patch(patches).select("repo_full_name", F.struct(*FIELDS).alias("_new"))
    both = current.join(patch, "repo_full_name", "full_outer")
    cur, new = F.col("_cur"), F.col("_new")
    return both.select(
        "repo_full_name",
        *[
            F.coalesce(
                new[f], F.when(cur.isNotNull(), cur[f]).otherwise(_typed(f, schemas.CONFIG_ROW_DEFAULTS[f]))
            ).alias(f)
            for f in FIELDS
        ],
    )
