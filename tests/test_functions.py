"""Scalar functions: severity guess, threat score, timestamps, text rules."""

from datetime import datetime

from pyspark.sql import functions as F

from sieveline.functions.severity import cef_severity, guess_severity, threat_score
from sieveline.functions.text import (contains_ci, embed_text, first_ipv4, keyword_like_pattern, preview,
                                      question_keywords, question_severity, render_line)
from sieveline.functions.timeparse import parse_timestamp
from sieveline.sources.cef import CEF_EXTENSION
from sieveline.functions.text import kv_map


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_guess_severity_groups_in_order(spark):
    cases = {
        "Kernel panic: error in module": "critical",  # critical group wins over high
        "Failed password for root": "high",
        "disk warning threshold": "medium",
        "NOTICE: rotated": "low",
        "debug trace on": "info",
        "errors everywhere": "info",  # whole words only
        "nothing here": "info",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["s"] for r in df.select("v", guess_severity(F.col("v")).alias("s")).collect()}
    assert got == cases


def test_threat_score_goldens(spark):
    rows = [("info", "User logged in successfully"), ("critical", "System error"),
            ("high", "Brute force attack detected from 10.0.0.1"), ("medium", "Failed password for root from 192.0.2.1")]
    df = spark.createDataFrame(rows, "sev string, msg string")
    got = [round(r[0], 6) for r in df.select(threat_score(F.col("sev"), F.col("msg"))).collect()]
    assert got == [0.0, 0.5, 1.0, 0.45]


def test_cef_severity(spark):
    df = spark.createDataFrame([("7",), ("10",), ("0",), ("High",), (" 5 ",)], "v string")
    assert [r[0] for r in df.select(cef_severity(F.col("v"))).collect()] == ["high", "critical", "info", "info", "medium"]


def test_parse_timestamp_forms(spark):
    cases = [
        ("2024-01-15T10:00:00Z", datetime(2024, 1, 15, 10, 0), "parsed"),
        ("2024-01-15T10:00:00+02:00", datetime(2024, 1, 15, 8, 0), "parsed"),
        ("2024-01-15 10:00:00,250", datetime(2024, 1, 15, 10, 0, 0, 250000), "parsed"),
        ("1705312800", datetime(2024, 1, 15, 10, 0), "epoch"),
        ("1705312800000", datetime(2024, 1, 15, 10, 0), "epoch"),
        ("01/15/2024 10:00:00", datetime(2024, 1, 15, 10, 0), "parsed"),
        ("15/01/2024 10:00:00", datetime(2024, 1, 15, 10, 0), "parsed"),
        ("Jan 15 2024 10:00:00", datetime(2024, 1, 15, 10, 0), "parsed"),
        ("2024", None, None),
        ("10:00", None, None),
        ("not a time", None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "v string")
    got = {r["v"]: (r["t"]["ts"], r["t"]["quality"]) for r in df.select("v", parse_timestamp(F.col("v")).alias("t")).collect()}
    for text, ts, q in cases:
        assert got[text] == (ts, q), text


def test_a_timestamp_matches_each_pattern_once(spark):
    from sieveline.functions.timeparse import with_parsed_timestamp
    cases = {"1/2/2024 12:05 am": datetime(2024, 1, 2, 0, 5), "13-2-2024 1:05:07.25 PM": datetime(2024, 2, 13, 13, 5, 7, 250000),
             "Mon, 15 January 2024 10:00:00 +0130": datetime(2024, 1, 15, 8, 30), "Sept. 3, 2024": datetime(2024, 9, 3),
             "Foo 3 2024": None, "1/2/2024 13:05 pm": None, " 2024/1/15\t10:00:00 ": datetime(2024, 1, 15, 10),
             "20240115T101112-0100": datetime(2024, 1, 15, 11, 11, 12), None: None}
    df = with_parsed_timestamp(spark.createDataFrame([(c,) for c in cases], "v string"), "v", "t").select("v", "t.ts", "t.quality")
    assert {r.v: r.ts for r in df.collect()} == cases
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" not in plan and plan.count("^(?:[A-Za-z]{3,9},? )?([A-Za-z]{3,9})") == 2  # shape, groups


def test_events_in_timestamp_forms_are_spread(spark, tmpdir_path):
    from sieveline.plans import catalog
    spark.createDataFrame([(i, datetime(2024, 1, 20, 1, 2, 3)) for i in range(40)], "event_id long, ts timestamp_ntz") \
        .coalesce(1).write.parquet(f"{tmpdir_path}/events.parquet")
    out = catalog.Q["timestamp_forms"](spark, tmpdir_path)
    assert out.rdd.getNumPartitions() > 1 and out.where("quality = 'parsed'").count() == 400


def test_cef_extension_quirks(spark):
    m = one(spark, kv_map(F.col("v"), CEF_EXTENSION), "url=http://x?a=b msg= next=v src=10.0.0.1")
    assert m["url"] == "http://x?a"
    assert m["msg"] == "next"
    assert m["src"] == "10.0.0.1"


def test_ilike_backslash_is_literal(spark):
    df = spark.createDataFrame([("login by CORP\\svc ok",), ("other",)], "v string")
    assert df.where(contains_ci(F.col("v"), "corp\\svc")).count() == 1
    assert df.where(contains_ci(F.col("v"), "by%svc")).count() == 1  # live wildcard


def test_question_rules(spark):
    q = "Show me failed logins from 10.0.0.5 last hour with HIGH severity"
    df = spark.createDataFrame([(q,)], "v string")
    r = df.select(question_severity(F.col("v")).alias("s"), first_ipv4(F.col("v")).alias("ip"),
                  keyword_like_pattern(question_keywords(F.col("v"))).alias("p")).first()
    assert r["s"] == "high"
    assert r["ip"] == "10.0.0.5"
    assert r["p"] == "%failed%logins%with%high%severity%"


def test_embed_text_and_preview(spark):
    df = spark.createDataFrame([("high", "sshd", "", "x" * 130)], "sev string, src string, host string, msg string")
    r = df.select(embed_text(F.col("sev"), F.col("src"), F.col("host"), F.col("msg")).alias("e"),
                  preview(F.col("msg"), 120).alias("p")).first()
    assert r["e"] == "[HIGH] source=sshd " + "x" * 130
    assert r["p"] == "x" * 120 + "..."


def test_render_line(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 15, 10, 0, 0, 5), "high", "", "sshd", "boom")],
                               "ts timestamp, sev string, host string, src string, msg string")
    r = df.select(render_line(F.col("ts"), F.col("sev"), F.col("host"), F.col("src"), F.col("msg"))).first()[0]
    assert r == "[2024-01-15T10:00:00.000005] [HIGH] host=sshd | boom"
