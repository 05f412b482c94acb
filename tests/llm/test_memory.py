"""What workers hold from task to task."""

from pathlib import Path

import numpy as np
import pyarrow as pa

import corpus_pipeline
from quern.llm import quality_fm
from quern.llm._util import trimmed


def test_workers_give_memory_back():
    def run(batches):
        held = [np.ones(12_000) for _ in range(2000)]  # 192 MB, too small each for pages of its own
        yield np.ones(12_000)  # stays above them
        del held

    def grown(f):
        rss = lambda: int(Path("/proc/self/statm").read_text().split()[1]) >> 8
        before = rss()
        kept = list(f(iter(())))
        return rss() - before, kept

    assert grown(trimmed(run))[0] < 60
    assert [x.num_rows for x in (trimmed(lambda t: t)(pa.table({"a": [1, 2]})),)] == [2]


def test_quality_rows_in_order_whatever_the_batches():
    lists = pa.array([[1, 2], [3], [], [4, 5, 6], [7]], pa.list_(pa.int32()))
    b = pa.RecordBatch.from_arrays([pa.array([5, -2, 9, 5, 1]), lists, lists.cast(pa.list_(pa.float32())), lists.cast(pa.list_(pa.float32())), pa.array([1, 0, 1, 0, 1], pa.int32()), pa.array([0, 1, 0, 1, 0], pa.int32())], quality_fm.SAMPLE.names)
    for parts in ([b], [b.slice(0, 2), b.slice(2)], [b.slice(i, 1) for i in range(5)]):
        rows, y = quality_fm._ordered(iter(parts))
        assert [i.tolist() for i, _ in rows] == [[3], [7], [4, 5, 6], [1, 2], []]
        assert all(np.array_equal(x, np.stack([i, i], axis=1)) for i, x in rows)
        assert y.tolist() == [[0, 1], [1, 0], [0, 1], [1, 0], [1, 0]]
    rows, y = quality_fm._ordered(iter(()))
    assert rows == [] and y.shape == (0, 2)


def test_pipeline_bounds_arrow_batches(spark):
    corpus_pipeline.exact(spark, spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id bigint, text string"), "")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
