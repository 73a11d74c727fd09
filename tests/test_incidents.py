"""Summaries by a user's functions, model replies, empty inputs; explanations' numbers; filled buckets; IDF vectors."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions.text import fixed_text
from sieveline.operators import anomalies, incidents, search, vectors
from sieveline.sources.scratch import scratch_path

T0 = datetime(2025, 3, 3, 8)
SCHEMA = "id string, timestamp timestamp, source string, hostname string, severity string, message string, log_type string"


def logs_of(spark, n, hosts=("h1", "h2", None)):
    rows = [(f"{i:05d}", T0 + timedelta(seconds=i % 97), "svc", hosts[i % len(hosts)], ["info", "high"][i % 2], f"m{i}", "json")
            for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_hierarchical_summaries_see_bounded_groups_in_order(spark):
    seen = spark.sparkContext.accumulator(0)

    def chunk(lines):
        assert 0 < len(lines) <= 7
        seen.add(1)
        return "".join(line.rsplit("| ", 1)[1] + ";" for line in lines)

    def merge(parts):
        assert 1 < len(parts) <= 3
        return "".join(parts)
    logs = logs_of(spark, 400)
    got = {r.hostname: r.summary for r in incidents.summarize_incidents(logs, chunk, merge, ["hostname"], 7, 3).collect()}
    for host in ("h1", "h2", None):
        own = sorted((r.timestamp, r.id, r.message) for r in logs.collect() if r.hostname == host)
        assert got[host] == "".join(m + ";" for _, _, m in own)
    assert seen.value >= 3 * 19
    one = incidents.summarize_incidents(logs.limit(5), chunk, merge, None, 7, 3).collect()
    assert len(one) == 1 and one[0].summary.count(";") == 5
    assert incidents.summarize_incidents(logs.limit(0), chunk, merge, ["hostname"]).collect() == []


def test_empty_inputs_and_prompts(spark):
    logs = logs_of(spark, 120)
    none = logs.limit(0)
    row = incidents.incident_summary(none).first()
    assert (row.title, row.recommendation, row.log_count, row.severity) == ("No logs provided", "N/A", 0, "info")
    assert incidents.security_report(none).first().report == "No log data available for the specified time range."
    assert incidents.incident_summary(none, by=["hostname"]).count() == 0 and incidents.incident_summary(logs).count() == 1
    prompt = incidents.report_prompts(logs, time_range="last week").first().prompt
    assert prompt.startswith("Security log report for last week.\n\nStatistics:\n  Total logs: 120\n  - high: 60\n  - info: 60\n")
    assert prompt.count(" | m") == 100 and prompt.endswith("Generate a professional security report.")
    assert incidents.report_prompts(logs).first().prompt.startswith("Security log report.\n")
    asked = incidents.incident_prompts(logs, ["hostname"]).where("hostname = 'h1'").first().prompt
    assert asked.startswith("Analyze these 40 security log entries:\n\n[2025-03-03T") and asked.count(" | m") == 40
    assert incidents.report_prompts(none).count() == 0


def test_model_replies(spark):
    logs = logs_of(spark, 60, hosts=("a", "b", "c", "d", "e", None))
    replies = spark.createDataFrame([
        ("a", '```json\n{"title": "T", "severity": "HIGH", "affected_hosts": ["x", "y"], "timeline": [{"time": "1", "event": "e"}],'
              ' "recommendation": "R"}\n```'),
        ("b", "{}"), ("c", "not json"), ("d", '{"severity": "terrible"}'), (None, '{"title": "null host"}')],
        "hostname string, reply string")
    got = {r.hostname: r for r in incidents.summaries_from_replies(logs, replies, ["hostname"]).collect()}
    plain = {r.hostname: r for r in incidents.incident_summary(logs, ["hostname"]).collect()}
    a = got["a"]
    assert (a.title, a.severity, a.affected_hosts, a.timeline, a.recommendation, a.log_count, a.from_reply) == (
        "T", "high", "x, y", "1 e", "R", 10, True)
    assert (got["b"].title, got["b"].severity, got["b"].recommendation) == ("Incident detected", "medium", "Investigate further.")
    for host in "cde":
        assert not got[host].from_reply and got[host].title == plain[host].title and got[host].timeline == plain[host].timeline
    assert got[None].title == "null host"


def test_fixed_text_is_pythons_format(spark):
    rng = random.Random(1)
    xs = [k / n for n in (1, 3, 4, 7, 8, 16, 20, 40, 80, 200) for k in range(0, 400, 3)]
    xs += [rng.uniform(0, 50) for _ in range(300)] + [0.05, 0.15, 0.25, 1.005, 2.675, 9.95, 0.9995, 1e-9, 0.5 + 2**-53, -1.65, 123456.25]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (1, 2, 3):
        got = df.select("x", fixed_text(F.col("x"), digits).alias("t")).collect()
        assert all(r.t == f"{r.x:.{digits}f}" for r in got), [(r.x, r.t) for r in got if r.t != f"{r.x:.{digits}f}"][:5]


def test_filled_buckets_equal_a_calendar(spark):
    rng = random.Random(4)
    rows = []
    for key in ("a", "b", "flat", None):
        for _ in range(60 if key != "flat" else 0):
            rows.append((T0 + timedelta(minutes=10 * rng.randint(0, 40)), key))
    rows += [(T0 + timedelta(minutes=10 * i), "flat") for i in range(5)]
    logs = spark.createDataFrame(rows, "timestamp timestamp, source string")
    got = {(r.key, r.bucket): r for r in anomalies.bucket_zscores(logs, fill_empty=True).collect()}
    for key in ("a", "b", "flat", None):
        times = [t for t, k in rows if k == key]
        counts = {}
        t = min(times)
        while t <= max(times):
            counts[t] = times.count(t)
            t += timedelta(minutes=10)
        mean, std = np.mean(list(counts.values())), np.std(list(counts.values()))
        for t, n in counts.items():
            assert ((key, t) in got) == (n > 0)
            if n:
                r = got[(key, t)]
                assert r.n_buckets == len(counts) and math.isclose(r.mean, mean)
                assert r.zscore is None if std == 0 else math.isclose(r.zscore, (n - mean) / std, rel_tol=1e-9)


def test_idf_vectors_and_later_batches(spark):
    from pyspark.ml.feature import HashingTF
    texts = ["error disk full", "error network down", "error disk", "login ok"]
    path = scratch_path(spark, "idf")
    vectors.fit_idf(spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "text string"), path, dim=32)
    embed = vectors.idf_embedder(path)
    place = HashingTF(numFeatures=32)
    later = [*texts, "error unseen words", "disk disk full"]
    got = {r.text: r.embedding for r in embed(spark.createDataFrame([(t,) for t in later], "text string")).collect()}
    seen = [{place.indexOf(w) for w in t.split()} for t in texts]  # repeated texts count once
    for t in later:
        v = np.zeros(32)
        for w in t.split():
            i = place.indexOf(w)
            v[i] += math.log((len(texts) + 1) / (sum(i in s for s in seen) + 1))
        assert np.allclose(got[t], v / (np.linalg.norm(v) or 1), atol=1e-6)


@pytest.mark.parametrize("given, want", [({"hostname": "H1"}, 40), ({"hostname": "h"}, 80), ({"hostname": "h1", "source": "nope"}, 0),
                                         ({"log_type": "JSON"}, 120), ({"log_type": "cef"}, 0), ({"hostname": "_1"}, 40)])
def test_hostname_and_log_type_filters(spark, given, want):
    assert search.search_logs(logs_of(spark, 120), limit=None, **given).count() == want


def test_outliers_come_farthest_first(spark):
    rows = [(str(i), [float(i % 7), 0.0]) for i in range(30)]
    got = [r.distance for r in anomalies.vector_outliers(spark.createDataFrame(rows, "id string, embedding array<double>"), 1.0).collect()]
    assert got == sorted(got, reverse=True) and len(got) > 5
