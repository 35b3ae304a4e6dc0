"""What a Python worker holds: bounded Arrow batches in, and no freed memory after a task."""

import os
import re
import subprocess
import sys

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import scratch

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("given, wanted", [(None, scratch.BATCH_BYTES), ("1m", 1 << 20)])
def test_stages_bound_arrow_batches(spark, given, wanted):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    try:
        spark.conf.unset(LIMIT) if given is None else spark.conf.set(LIMIT, given)
        docs = spark.range(0, 6000, numPartitions=1).select(F.col("id").alias("doc_id"), F.format_string("%02000d", "id").alias("text"))
        corpus_pipeline.tokens_stage(spark, docs, "")
        got = [x.n for x in docs.mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.unset(LIMIT)
    assert 12_000_000 < sum(got) < 13_000_000 and max(got) < wanted + (1 << 16)


def test_released_memory_goes_back():
    code = """
import re
from tessera.llm import scratch
held = lambda: int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
blocks = [bytes(10_000) for _ in range(20_000)]
full, last = held(), blocks[-1]  # the last block keeps the top of the heap
del blocks
scratch.release()
print(full - held())
"""
    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("memory can't be read here")
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert int(re.findall(r"-?\d+", run.stdout)[-1]) > 150
