import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlake.llm.bitmaps import bitmap, passes, unpacked


@pytest.mark.parametrize(("log", "most"), [(30, 30_000), (22, 30_000), (10, 1_000)])
def test_a_bitmap_of_few_hashes_is_sent_as_few_bytes(spark, log, most):
    """A broadcast of 2^30 bits took 128 MB of disk on the driver and on every executor."""
    hashes = spark.range(2_000).select(F.xxhash64("id").alias("h"))
    sent = pickle.dumps(bitmap(hashes, "h", log))
    assert len(sent) < most
    members = hashes.toArrow().column("h").to_numpy().view(np.uint64)
    bits = unpacked(pickle.loads(sent))
    assert len(bits) == 1 << (log - 6) and passes(bits, members).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 100_000, np.uint64) * np.uint64(2)
    own = np.unique(members >> np.uint64(64 - log))
    assert (passes(bits, others) == np.isin(others >> np.uint64(64 - log), own)).all()


def test_a_bitmap_of_no_hashes(spark):
    none = spark.range(0).select(F.xxhash64("id").alias("h"))
    assert not passes(unpacked(bitmap(none, "h", 22)), np.arange(10, dtype=np.uint64)).any()
