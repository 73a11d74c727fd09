"""Detector behaviour on hand-built logs (goldens derived by hand)."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sieveline.operators.anomalies import detect_anomalies, frequency_anomalies, severity_escalation

AS_OF = datetime(2025, 3, 3, 12, 0, 0)
SCHEMA = "id string, timestamp timestamp, source string, hostname string, severity string, message string"


def logs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def make(i, minutes_ago, sev="info", source="test", msg="event"):
    return (f"l{i:03d}", AS_OF - timedelta(minutes=minutes_ago), source, "", sev, msg)


def test_no_logs_returns_empty(spark):
    assert detect_anomalies(logs(spark, []), AS_OF).count() == 0


def test_escalation_detected(spark):
    rows = [make(i, 50 - i) for i in range(20)] + [make(100 + i, 10 - i, "critical") for i in range(10)]
    out = severity_escalation(logs(spark, rows)).collect()
    assert len(out) == 10
    assert all(abs(r["score"] - 1.0) < 1e-9 for r in out)
    assert all(r["method"] == "severity_escalation" for r in out)
    assert "rate jumped from 0.0% to 66.7%" in out[0]["explanation"]


def test_uniform_traffic_no_escalation(spark):
    rows = [make(i, i) for i in range(30)]
    assert severity_escalation(logs(spark, rows)).count() == 0


def test_escalation_per_group(spark):
    rows = [make(i, 50 - i, source="a") for i in range(20)] + \
           [make(100 + i, 10 - i, "high", source="a") for i in range(10)] + \
           [make(200 + i, i, source="b") for i in range(30)]
    out = severity_escalation(logs(spark, rows), by=["source"])
    assert out.count() == 10


def test_frequency_spike(spark):
    base = AS_OF.replace(minute=0) - timedelta(hours=1)
    rows = [(f"a{i}", base + timedelta(minutes=10 * i + 1), "server-a", "", "info", "normal") for i in range(6)]
    rows += [(f"b{i:02d}", base + timedelta(minutes=52, seconds=i), "server-a", "", "info", "burst") for i in range(20)]
    out = frequency_anomalies(logs(spark, rows)).collect()
    assert len(out) == 1
    assert abs(out[0]["score"] - (5 ** 0.5) / 5) < 1e-9
    assert out[0]["log_id"] == "b19"  # newest log of the bucket
    assert "21 events in bucket (mean=4.3, z-score=2.24)" in out[0]["explanation"]


def test_frequency_needs_five_logs(spark):
    rows = [make(i, 10 * i) for i in range(4)]
    assert frequency_anomalies(logs(spark, rows)).count() == 0


def test_detect_dedupes_and_orders(spark):
    rows = [make(i, 50 - i) for i in range(20)] + [make(100 + i, 10 - i, "critical") for i in range(10)]
    out = detect_anomalies(logs(spark, rows), AS_OF, minutes=60).collect()
    ids = [r["log_id"] for r in out]
    assert len(ids) == len(set(ids))
    assert [r["score"] for r in out] == sorted([r["score"] for r in out], reverse=True)


def test_split_halves_exact_with_shared_timestamps(spark):
    """Many rows on one timestamp (as with files lacking times) are ranked by id
    exactly like a global sort."""
    from sieveline.operators.anomalies import split_halves
    rows = [(f"{i:05x}", AS_OF, "s", "", "info", "m") for i in range(3000)]
    rows += [(f"z{i:03d}", AS_OF - timedelta(seconds=i % 7, minutes=i % 3), "s", "", "high", "m") for i in range(501)]
    df = logs(spark, rows)
    got = {r.id: r.late for r in split_halves(df).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    half = len(order) // 2
    want = {r[0]: i >= half for i, r in enumerate(order)}
    assert got == want
    by = {r.id: r.late for r in split_halves(df, by=["severity"]).collect()}
    for sev in ("info", "high"):
        grp = sorted([r for r in rows if r[4] == sev], key=lambda r: (r[1], r[0]))
        assert all(by[r[0]] == (i >= len(grp) // 2) for i, r in enumerate(grp))


def test_frequency_spike_of_logs_without_a_source(spark):
    base = AS_OF.replace(minute=0) - timedelta(hours=1)
    rows = [(f"a{i}", base + timedelta(minutes=10 * i + 1), None, "", "info", "normal") for i in range(6)]
    rows += [(f"b{i:02d}", base + timedelta(minutes=52, seconds=i), None, "", "info", "burst") for i in range(20)]
    assert [r["log_id"] for r in frequency_anomalies(logs(spark, rows)).collect()] == ["b19"]
