"""Threat rules as data, against the fixed expression and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions.severity import threat_score
from sieveline.operators import rules as R
from sieveline.schema import SEVERITIES, SEVERITY_WEIGHT


def logs_of(spark, messages):
    return spark.createDataFrame([(str(i), SEVERITIES[i % 5], m) for i, m in enumerate(messages)],
                                 "id string, severity string, message string")


def test_fixed_rules_as_a_table(spark):
    logs = logs_of(spark, ["Brute Force attack with MALWARE", "denied", None, "", "port scan, port scan",
                           "invalid user root login: failed password", "nothing"])
    got = {r.id: r.score for r in R.score_by_rules(logs, R.default_rules(spark)).collect()}
    want = {r.id: r.score for r in logs.select("id", threat_score(F.col("severity"), F.col("message")).alias("score")).collect()}
    assert {k: round(v, 12) for k, v in got.items()} == {k: round(v if v is not None else 0, 12) for k, v in want.items()
                                                         if v is not None} | {
        k: SEVERITY_WEIGHT[SEVERITIES[int(k) % 5]] * 0.5 for k, v in want.items() if v is None}


@pytest.mark.parametrize("n", [0, 400])
def test_random_rules_match_a_search_of_every_rule(spark, n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 7)))
    given = [(i, rng.choice([word(), word() + " " + word(), ""]), rng.randint(0, 9) / 100) for i in range(n)]
    given += [(n, None, 0.5), (n + 1, "aa", 0.01), (n + 2, "aa", 0.02)] if n else []
    messages = [" ".join(word() for _ in range(rng.randint(0, 12))).upper() for _ in range(150)]
    rules = spark.createDataFrame(given, "position int, keyword string, boost double")
    got = {r.id: r.score for r in R.score_by_rules(logs_of(spark, messages), rules).collect()}
    for i, m in enumerate(messages):
        score = SEVERITY_WEIGHT[SEVERITIES[i % 5]] * 0.5
        score += sum(b for _, k, b in given if k and k in m.lower())
        assert abs(got[str(i)] - min(score, 1.0)) < 1e-9


def test_the_plan_does_not_grow_with_the_rules(spark):
    logs = logs_of(spark, ["user 77 logged in"] * 20)
    plans = []
    for n in (10, 100_000):
        rules = spark.range(n).select(F.col("id").cast("int").alias("position"),
                                      F.concat(F.lit("user "), F.col("id").cast("string"), F.lit(" ")).alias("keyword"),
                                      F.lit(0.25).alias("boost"))
        out = R.score_by_rules(logs, rules)
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        hit = out.where("severity = 'info'").first().score
        assert hit == (0.25 if n > 77 else 0.0)
    assert plans[0] == plans[1]
