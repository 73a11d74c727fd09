"""Streaming z-scores against their batch forms, over several batches with late rows."""

import os
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sieveline.operators.anomalies import bucket_zscores
from sieveline.sources.scratch import scratch_path
from sieveline.streaming import spikes

T0 = datetime(2025, 3, 3)


def stream_of(spark, root, parts):
    for part in parts:
        spark.createDataFrame(part, "timestamp timestamp, source string").coalesce(1).write.mode("append").parquet(root)
        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema("timestamp timestamp, source string").option("maxFilesPerTrigger", 1).parquet(root)


def test_scores_leave_the_stream_and_equal_the_batch(spark):
    rng, rows = random.Random(1), []
    for m in range(480):
        for k in ("a", "b", "flat"):
            n = 30 if k == "a" and 300 <= m < 310 else 1 if k == "flat" else rng.randint(0, 3)
            rows += [(T0 + timedelta(minutes=m, seconds=rng.randint(0, 59)), k) for _ in range(n)]
    # A tenth of the rows come up to eight minutes late, some of them a batch later.
    arrival = sorted((t + timedelta(minutes=rng.choice([8] + [0] * 9)), t, k) for t, k in rows)
    n = len(arrival)
    parts = [[(t, k) for _, t, k in arrival[i * n // 4:(i + 1) * n // 4]] for i in range(4)]
    parts.append([(T0 + timedelta(hours=1), "b")] * 50 + [(T0 + timedelta(hours=9), "end")])  # too late; closes the rest
    root = scratch_path(spark, "spikes")
    query = spikes.run_spikes(spikes.spike_stream(stream_of(spark, f"{root}/in", parts)), f"{root}/out", f"{root}/ck")
    query.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    logs = spark.createDataFrame(rows, "timestamp timestamp, source string")

    def table(df, *cols):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r)
                      for r in df.select("key", "bucket", "count", *cols).collect())
    assert table(out, "n_buckets", "zscore") == table(spikes.running_zscores(logs), "n_buckets", "zscore")
    assert table(spikes.settled_zscores(out), "zscore") == table(bucket_zscores(logs), "zscore")
    found = out.where(spikes.is_spike()).collect()
    assert (T0 + timedelta(hours=5), "a") in {(r.bucket, r.key) for r in found} and "flat" not in {r.key for r in found}
    assert len({p["batchId"] for p in query.recentProgress}) >= 5
    assert out.select(F.input_file_name().alias("f")).distinct().count() > 2  # rows of several batches


def test_null_keys_and_a_restart(spark):
    root = scratch_path(spark, "spikes")
    a = [(T0 + timedelta(minutes=m), None) for m in range(0, 60)]
    b = [(T0 + timedelta(minutes=m), None) for m in range(60, 200, 2)]
    for part in (a, b):  # the state goes on from the checkpoint
        scored = spikes.spike_stream(stream_of(spark, f"{root}/in", [part]))
        spikes.run_spikes(scored, f"{root}/out", f"{root}/ck").awaitTermination()
    got = spark.read.parquet(f"{root}/out").orderBy("bucket").collect()
    assert [r["count"] for r in got] == [10] * 6 + [5] * 12 and [r.n_buckets for r in got] == list(range(1, 19))
    assert all(r.zscore is None for r in got[:6]) and got[6].zscore < 0
    assert os.path.isdir(f"{root}/ck".removeprefix("file:"))
