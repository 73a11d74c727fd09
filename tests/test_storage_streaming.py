"""Sinks (upsert, delete, Parquet round trip) and streaming jobs."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sieveline.schema import LOG_COLUMNS
from sieveline.session import checkpoint_root
from sieveline.sources.sinks import delete_logs, read_logs, upsert_logs, write_logs
from sieveline.streaming import feed

T0 = datetime(2025, 3, 3, 8, 0, 0)


def log_rows(spark, n, ingested=T0, msg="m", step=timedelta(minutes=1)):
    rows = [(f"id{i}", T0 + i * step, "svc", "h1", ["info", "high", "critical"][i % 3], f"{msg}{i}",
             "raw", {}, "f", "syslog", "parsed", ingested, (T0 + i * step).date()) for i in range(n)]
    from sieveline.schema import LOG_SCHEMA
    return spark.createDataFrame(rows, LOG_SCHEMA)


def test_upsert_replaces_by_id(spark):
    old = log_rows(spark, 5)
    new = log_rows(spark, 2, ingested=T0 + timedelta(days=1), msg="new")
    out = {r["id"]: r["message"] for r in upsert_logs(old, new).collect()}
    assert out == {"id0": "new0", "id1": "new1", "id2": "m2", "id3": "m3", "id4": "m4"}


def test_delete_by_ids(spark):
    logs = log_rows(spark, 5)
    ids = spark.createDataFrame([("id1",), ("id3",), ("nope",)], "id string")
    assert sorted(r.id for r in delete_logs(logs, ids).collect()) == ["id0", "id2", "id4"]


def test_write_read_roundtrip(spark):
    path = checkpoint_root(spark) + "/logs-table-test"
    logs = log_rows(spark, 4, step=timedelta(days=1))
    write_logs(logs, path)
    back = read_logs(spark, path)
    assert back.count() == 4 and back.columns == LOG_COLUMNS
    # Dynamic overwrite replaces only the partitions written.
    write_logs(log_rows(spark, 1, msg="again"), path)
    back = read_logs(spark, path)
    assert back.count() == 4 and back.where(F.col("message") == "again0").count() == 1


def test_fan_out_batch(spark):
    logs = log_rows(spark, 6)
    subs = feed.subscriptions_table(spark, {"soc": ["critical", "high"], "all": None})
    got = sorted((r.subscriber, r.id) for r in feed.fan_out(logs, subs).collect())
    assert len([g for g in got if g[0] == "all"]) == 6
    assert len([g for g in got if g[0] == "soc"]) == 4


def test_stream_counts_and_feed(spark):
    root = checkpoint_root(spark) + "/stream-test"
    src = root + "/in"
    log_rows(spark, 180).write.mode("overwrite").parquet(src)
    schema = log_rows(spark, 1).schema
    stream = spark.readStream.schema(schema).parquet(src)
    feed.run_to_table(feed.hourly_counts_stream(stream), root + "/counts", root + "/ck1")
    counts = spark.read.parquet(root + "/counts")
    # 180 minutes from 08:00 -> hours 08, 09 closed by the watermark (max 10:59 - 10 min); hour 10 still open.
    assert sorted({r.hour.hour for r in counts.collect()}) == [8, 9]
    assert counts.agg(F.sum("count")).first()[0] == 120
    subs = feed.subscriptions_table(spark, {"soc": ["critical"]})
    feed.run_to_table(feed.feed_view(feed.fan_out(spark.readStream.schema(schema).parquet(src), subs)),
                      root + "/feed", root + "/ck2")
    assert spark.read.parquet(root + "/feed").count() == 60


def test_ingest_stream(spark, tmpdir_path):
    incoming = os.path.join(tmpdir_path, "incoming")
    os.makedirs(incoming)
    with open(os.path.join(incoming, "a.log"), "w") as f:
        f.write("Jan 15 10:00:00 h1 sshd[1]: Failed password for root\nJan 15 10:00:01 h1 sshd[1]: ok\n")
    with open(os.path.join(incoming, "b.cef"), "w") as f:
        f.write("CEF:0|V|P|1|1|Login|9|src=192.0.2.1\n")
    table = os.path.join(tmpdir_path, "table")
    q = feed.ingest_stream(spark, incoming, table, os.path.join(tmpdir_path, "ck"), year=2025,
                           ingested_at=datetime(2025, 6, 1))
    q.awaitTermination()
    out = read_logs(spark, table)
    assert out.count() == 3
    assert sorted(r.log_type for r in out.collect()) == ["cef", "syslog", "syslog"]


def test_ingest_stream_documents_and_replay(spark, tmpdir_path):
    """A JSON document over several lines is one record as in batch ingest; a replay adds nothing."""
    from sieveline.sources.ingest import ingest_files
    incoming = os.path.join(tmpdir_path, "in2")
    os.makedirs(incoming)
    with open(os.path.join(incoming, "win.json"), "w") as f:
        f.write('[\n {"EventID": 4625, "Level": "Error", "Computer": "pc1", "Message": "failed logon",\n'
                '  "TimeCreated": "2025-01-15T10:00:00Z"}\n]\n')
    with open(os.path.join(incoming, "a.log"), "w") as f:
        f.write("Jan 15 10:00:00 h1 sshd[1]: Failed password for root\n")
    table, report = os.path.join(tmpdir_path, "t2"), os.path.join(tmpdir_path, "r2")
    for ck in ("ck-a", "ck-b"):
        feed.ingest_stream(spark, incoming, table, os.path.join(tmpdir_path, ck), year=2025,
                           ingested_at=datetime(2025, 6, 1), report_path=report).awaitTermination()
    key = lambda df: sorted((r.id, r.log_type, r.message) for r in df.collect())
    batch = ingest_files(spark, incoming, directory=True, year=2025, ingested_at=datetime(2025, 6, 1)).logs
    assert key(read_logs(spark, table)) == key(batch)
    assert sorted(r.log_type for r in batch.collect()) == ["syslog", "windows_event"]
    assert spark.read.parquet(report).where("parsed = 1").count() == 2


def test_stored_upsert_and_delete(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from sieveline.sources import sinks
    logs = sinks.read_logs(spark, _write_three_days(spark, tmpdir_path))
    path = os.path.join(tmpdir_path, "days")
    assert sinks.delete_stored(spark, spark.createDataFrame([("nope",)], "id string"), path) == 0
    moved = logs.where("id = '1'").withColumn("timestamp", F.expr("timestamp + INTERVAL 1 DAY")) \
                .withColumn("event_date", F.to_date("timestamp")).withColumn("message", F.lit("moved"))
    moved = spark.createDataFrame(moved.collect(), logs.schema)
    for _ in range(2):
        sinks.upsert_stored(spark, moved, path)
    got = {r.id: (r.message, str(r.event_date)) for r in sinks.read_logs(spark, path).collect()}
    assert got == {"1": ("moved", "2025-01-02"), "2": ("m2", "2025-01-02"), "3": ("m3", "2025-01-03")}
    assert not [d for d in os.listdir(path) if d == "event_date=2025-01-01"]
    assert sinks.delete_stored(spark, None, path) == 3
    assert sinks.read_logs(spark, path).count() == 0


def _write_three_days(spark, folder):
    from sieveline.schema import LOG_SCHEMA
    from sieveline.sources.sinks import write_logs
    rows = [{"id": str(i), "timestamp": datetime(2025, 1, i, 10), "source": "s", "hostname": "h", "severity": "info",
             "message": f"m{i}", "raw": "r", "metadata": {"a": "b"}, "source_file": "f", "log_type": "json",
             "ts_quality": "parsed", "ingested_at": datetime(2025, 2, 1), "event_date": datetime(2025, 1, i).date()}
            for i in (1, 2, 3)]
    path = os.path.join(folder, "days")
    write_logs(spark.createDataFrame(rows, LOG_SCHEMA), path)
    return path


def test_time_search_prunes_partitions_and_pushes_filters(spark):
    from sieveline.operators.search import recent, search_logs
    path = checkpoint_root(spark) + "/logs-prune-test"
    write_logs(log_rows(spark, 10, step=timedelta(days=1)), path)
    stored = read_logs(spark, path)
    q = search_logs(stored, severity="critical", start_time="2025-03-05", end_time="2025-03-07", limit=None)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "event_date" in plan.split("PartitionFilters")[1]
    assert "PushedFilters" in plan and "timestamp" in plan.split("PushedFilters")[1]
    got = sorted(r.id for r in q.collect())
    # in range: id2 (03-05 08:00, critical), id3 (03-06, info); id4 is 03-07 08:00, after the midnight end
    assert got == ["id2"]
    assert recent(stored, datetime(2025, 3, 6, 9, 0), minutes=120).count() == 1
