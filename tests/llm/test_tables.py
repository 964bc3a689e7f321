import time
from pathlib import Path

from pyspark.sql import functions as F

from revlake.llm.components import components
from revlake.llm.tables import written


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*")}


def test_shuffles_end_with_the_job_that_wrote_them(spark):
    """Steps of many small jobs over many partitions would keep a disk block for each of their files."""
    before = shuffle_files(spark)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = written(components(chain), "labels")
    deadline = time.monotonic() + 20
    while shuffle_files(spark) - before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(setting, None) == was
    assert labels.count() == 61 and labels.agg(F.max("label")).first()[0] == 0
