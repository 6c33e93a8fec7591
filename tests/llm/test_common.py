import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from granary.llm.common import SLICE_BYTES, hand_back, in_arrow


def test_batches_of_long_texts_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], ["n", "size"])
    docs = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))  # 40 MB in one task
    got = in_arrow(docs, sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 4000 and max(r.size for r in got) < 2.5 * SLICE_BYTES


def resident() -> int:
    with open("/proc/self/status") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("RssAnon")) * 1024


def test_freed_memory_is_handed_back():
    arrays = [np.ones(4000) for _ in range(4000)]  # 128 MB
    pinned = arrays[::100]
    del arrays
    before = resident()
    hand_back()
    assert len(pinned) == 40 and before - resident() > 64 << 20
