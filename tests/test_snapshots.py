"""Versioned tables: atomic commits, versions, conflicts, plain folders, vectors, replayed batches."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sieveline.schema import LOG_COLUMNS
from sieveline.sources import snapshots as S
from sieveline.sources.scratch import scratch_path

from test_storage_streaming import T0, log_rows


def messages(df):
    return {r.id: r.message for r in df.collect()}


def test_a_job_that_ends_before_its_commit_leaves_the_table_as_it_was(spark, monkeypatch):
    table = S.log_table(spark, scratch_path(spark, "t"))
    table.upsert(log_rows(spark, 5))
    opened = table.read()
    monkeypatch.setattr(S.SnapshotTable, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    for change in (lambda: table.upsert(log_rows(spark, 7, msg="new")), lambda: table.delete(None), table.reset,
                   lambda: table.write(log_rows(spark, 1, msg="w"))):
        with pytest.raises(KeyboardInterrupt):
            change()
        assert messages(table.read()) == messages(opened) == {f"id{i}": f"m{i}" for i in range(5)}
    monkeypatch.undo()
    assert table.vacuum() == 3  # what the upsert (new rows, the rest of their day) and the write left behind
    assert messages(table.read()) == messages(opened)


def test_versions_stay_readable_and_untouched_days_are_taken_over(spark):
    table = S.log_table(spark, scratch_path(spark, "t"))
    day = timedelta(days=1)
    first = table.upsert(log_rows(spark, 4, step=day))
    second = table.upsert(log_rows(spark, 2, ingested=T0 + day, msg="new", step=day))
    assert messages(table.read(1)) == {f"id{i}": f"m{i}" for i in range(4)}
    assert messages(table.read(2)) == {"id0": "new0", "id1": "new1", "id2": "m2", "id3": "m3"} == messages(table.read())
    days = sorted(first.parts)
    assert [first.parts[d] == second.parts[d] for d in days] == [False, False, True, True]
    assert messages(table.read(0)) == {}
    assert table.delete(spark.createDataFrame([("id2",), ("id2",), ("nope",)], "id string")) == 1
    assert table.delete(spark.createDataFrame([("nope",)], "id string")) == 0 and table.version().number == 3
    assert days[2] not in table.version().parts
    table.vacuum(keep=1)
    assert table.numbers() == [3] and sorted(messages(table.read())) == ["id0", "id1", "id3"]
    with pytest.raises(ValueError):
        table.read(1)


def test_a_row_that_moves_to_another_day_leaves_no_copy(spark):
    table = S.log_table(spark, scratch_path(spark, "t"))
    table.upsert(log_rows(spark, 3))
    moved = (log_rows(spark, 2, ingested=T0 + timedelta(days=1), msg="moved").where("id = 'id1'")
             .withColumn("event_date", F.lit(None).cast("date")))
    for _ in range(2):
        table.upsert(moved)
    assert messages(table.read()) == {"id0": "m0", "id1": "moved1", "id2": "m2"}
    assert S.NULL_PARTITION in table.version().parts
    table.compact()
    assert all(len(x) == 1 for x in table.version().parts.values())
    assert table.delete(None) == 3 and table.read().columns == LOG_COLUMNS and table.read().count() == 0
    assert table.upsert(log_rows(spark, 1).limit(0)).number == table.version().number


def test_two_writers_of_one_version(spark):
    path = scratch_path(spark, "t")
    table, other = S.log_table(spark, path), S.log_table(spark, path)
    table.upsert(log_rows(spark, 2))
    base = table.version()
    with pytest.raises(S.CommitConflict):
        table.commit(S.Version(base.number, base.parts))
    commit, raced = table.commit, []

    def slow(version):  # the other writer is faster once
        if not raced:
            raced.append(other.upsert(log_rows(spark, 1, ingested=T0 + timedelta(days=1), msg="other")))
        commit(version)
    table.commit = slow
    table.upsert(log_rows(spark, 3, ingested=T0 + timedelta(days=2), msg="late").where("id <> 'id0'"))
    assert messages(table.read()) == {"id0": "other0", "id1": "late1", "id2": "late2"}
    assert table.numbers() == [1, 2, 3]
    assert not [n for n in os.listdir(f"{path.removeprefix('file:')}/versions") if n.endswith(".tmp")]


def test_a_plain_folder_becomes_a_table(spark):
    path = scratch_path(spark, "t")
    log_rows(spark, 3, step=timedelta(days=1)).write.partitionBy("event_date").parquet(path)
    table = S.log_table(spark, path)
    assert len(messages(table.read())) == 3
    table.upsert(log_rows(spark, 2, ingested=T0 + timedelta(days=1), msg="new", step=timedelta(days=1)))
    assert messages(table.read()) == {"id0": "new0", "id1": "new1", "id2": "m2"}
    assert len(messages(table.read(0))) == 3


def test_stored_vectors_and_pending_logs(spark):
    from sieveline.operators.vectors import hashing_embedder
    logs, vectors = (make(spark, scratch_path(spark, "t")) for make in (S.log_table, S.vector_table))
    logs.upsert(log_rows(spark, 6))
    assert S.embed_pending(logs, vectors, limit=2) == 2
    assert sorted(r.id for r in vectors.read().collect()) == ["id0", "id1"]  # oldest first
    assert S.embed_pending(logs, vectors) == 4 and S.embed_pending(logs, vectors) == 0
    row = vectors.read().where("id = 'id1'").first()
    assert row.document == "[HIGH] source=svc host=h1 m1" and len(row.embedding) == 64
    want = hashing_embedder()(spark.createDataFrame([(row.document,)], "text string")).first().embedding
    assert row.embedding == want
    before = vectors.version().number
    vectors.reset()
    assert vectors.read().count() == 0 and vectors.read(before).count() == 6


def write_lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("".join(x + "\n" for x in lines))


def test_ingest_embeds_every_log_and_leaves_out_replayed_batches(spark, tmpdir_path, monkeypatch):
    from sieveline.streaming import feed
    incoming, root = os.path.join(tmpdir_path, "in"), scratch_path(spark, "ingest")
    write_lines(incoming, "a.log", ["Jan 15 10:00:00 h1 sshd[1]: Failed password for root", "Jan 15 10:00:01 h1 sshd[1]: ok"])
    logs, vectors = S.log_table(spark, f"{root}/logs"), S.vector_table(spark, f"{root}/vectors")
    embedded = []

    def run():
        q = feed.ingest_stream(spark, incoming, f"{root}/logs", f"{root}/ck", year=2025, ingested_at=datetime(2025, 6, 1),
                               vectors_path=f"{root}/vectors", embedder=embedder)
        q.awaitTermination()

    def embedder(texts):
        from sieveline.operators.vectors import hashing_embedder
        embedded.append(texts.count())
        return hashing_embedder()(texts)

    run()
    ids = sorted(r.id for r in logs.read().collect())
    assert len(ids) == 2 and sorted(r.id for r in vectors.read().collect()) == ids and embedded == [2]
    # A batch that ends between the two commits is finished by the next run.
    write_lines(incoming, "b.log", ["Jan 15 11:00:00 h2 cron[2]: started"])
    store = S.store_vectors
    monkeypatch.setattr(S, "store_vectors", lambda *a: (_ for _ in ()).throw(RuntimeError("ended")))
    with pytest.raises(Exception):
        run()
    assert logs.read().count() == 3 and vectors.read().count() == 2
    monkeypatch.setattr(S, "store_vectors", store)
    numbers = logs.version().number
    run()
    assert logs.version().number == numbers  # the logs of the batch were there
    assert sorted(r.id for r in vectors.read().collect()) == sorted(r.id for r in logs.read().collect())
    # A batch whose number both tables have is left out whole.
    import shutil
    commits = f"{root}/ck/commits".removeprefix("file:")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    shutil.copytree(f"{root}/ck".removeprefix("file:"), os.path.join(tmpdir_path, "ck"))
    for name in (str(last), f".{last}.crc"):
        os.remove(os.path.join(tmpdir_path, "ck", "commits", name))
    before, calls = (logs.version().number, vectors.version().number), len(embedded)
    feed.ingest_stream(spark, incoming, f"{root}/logs", os.path.join(tmpdir_path, "ck"), year=2025,
                       ingested_at=datetime(2025, 6, 1), vectors_path=f"{root}/vectors", embedder=embedder).awaitTermination()
    assert (logs.version().number, vectors.version().number) == before and len(embedded) == calls


def test_a_write_makes_about_one_file_per_day_however_many_tasks(spark):
    """Before, every task wrote a file for each day it saw."""
    path = scratch_path(spark, "t")
    rows = log_rows(spark, 240, step=timedelta(hours=1)).repartition(8)
    S.log_table(spark, path).write(rows)
    back = S.log_table(spark, path).read()
    assert back.count() == 240 and len(back.inputFiles()) < 10 + spark.sparkContext.defaultParallelism * 2


def test_stored_vectors_of_many_days_lie_in_few_partitions(spark):
    table = S.vector_table(spark, scratch_path(spark, "t"))
    rows = spark.range(300).selectExpr(
        "cast(id as string) AS id", "array(1.0f) AS embedding", "'a' AS document", "'info' AS severity", "'' AS source",
        "'' AS hostname", "timestamp_seconds(1704067200 + id * 86400) AS timestamp", "'json' AS log_type")
    S.store_vectors(table, rows)
    S.store_vectors(table, rows.where("id < 3").withColumn("document", F.lit("b")))
    back = table.read()
    assert len(table.version().parts) == 10 and back.count() == 300
    assert back.where("document = 'b'").count() == 3 and back.where("event_date <> to_date(timestamp)").count() == 0
