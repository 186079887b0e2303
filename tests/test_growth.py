"""Edges of the growth operators: thresholds, zero denominators, nulls, ties, empty tables."""

from __future__ import annotations

from docgrowth.functions.graph import components
from docgrowth.operators import growth as g
from docgrowth.operators import quality as q

CAMPAIGN = "id int, spend double, clicks long, impressions long, conversions long, revenue double, status string, daily_budget double"


def campaigns(spark, *rows):
    return spark.createDataFrame(list(rows), CAMPAIGN)


def test_actions_of_known_campaigns(spark):
    # Spend and revenue of five campaigns, with returns of 1.5, 0.6, 0.914, 0.267 and 3.0.
    money = [(100.0, 150.0), (100.0, 60.0), (350.0, 320.0), (150.0, 40.0), (100.0, 300.0)]
    df = campaigns(spark, *((i, s, 10, 100, 1, r, "ACTIVE", 10.0) for i, (s, r) in enumerate(money)))
    got = {r["id"]: r["action"] for r in g.roas_action(df).collect()}
    assert [got[i] for i in range(5)] == ["HOLD", "STOP", "STOP", "STOP", "SCALE"]


def test_thresholds_and_zero_spend(spark):
    df = campaigns(spark, (1, 0.0, 0, 0, 0, 5.0, "ACTIVE", 10.0), (2, 1.0, 1, 1, 1, 1.0, "ACTIVE", 10.0), (3, 1.0, 1, 1, 1, 2.0, "ACTIVE", 10.0))
    got = {r["id"]: r for r in g.roas_action(df).collect()}
    assert got[1]["roas"] == 0 and got[1]["action"] == "STOP"
    assert got[2]["action"] == "HOLD"
    assert got[3]["action"] == "SCALE" and got[3]["budget_rise"] == 20
    roi = {r["id"]: r for r in g.campaign_roi(df).collect()}
    assert roi[1]["ctr"] == roi[1]["cpc"] == roi[1]["roi"] == 0


def test_paused_campaigns_keep_their_budget(spark):
    got = g.auto_optimize_budget(campaigns(spark, (1, 1.0, 1, 1, 1, 3.0, "PAUSED", 10.0), (2, 1.0, 1, 1, 1, 3.0, "ACTIVE", 10.0))).collect()
    assert {r["id"]: (r["daily_budget"], r["action"]) for r in got} == {1: (10.0, None), 2: (13.0, "SCALE")}


def test_empty_table(spark):
    assert g.roas_action(campaigns(spark)).count() == 0
    assert g.value_funnel(spark.createDataFrame([], "doc_id int, event string, value_flag string")).first()["yes_ratio"] == 0


def test_first_variant_wins_a_tie(spark):
    totals = spark.createDataFrame([(2, 100, 5), (1, 100, 5), (3, 0, 0)], "variant int, impressions long, clicks long")
    assert g.ab_winner(totals).first()["variant"] == 1
    assert [r["variant"] for r in g.ab_rank(totals).orderBy("rank").collect()] == [1, 2, 3]


def test_quota_is_per_day(spark):
    rows = [(1, e, f"2024-01-0{1 + e // 4} 00:00:0{e}") for e in range(6)]
    df = spark.createDataFrame(rows, "user_id int, event_id int, ts string").selectExpr("user_id", "event_id", "ts", "substr(ts, 1, 10) AS day")
    got = {r["event_id"]: (r["n"], r["free"], r["remaining"]) for r in g.daily_quota(df).collect()}
    assert got[2] == (3, True, 0) and got[3] == (4, False, 0) and got[4] == (1, True, 2)


def test_fnv_vectors(spark):
    # Published vectors of 32-bit FNV-1a.
    df = spark.createDataFrame([("",), ("a",), ("foobar",)], "s string")
    got = {r["s"]: r["h"] for r in df.select("s", q.fnv1a(df["s"]).alias("h")).collect()}
    assert got == {"": 0x811C9DC5, "a": 0xE40C292C, "foobar": 0xBF9CF968}


def test_components_of_a_chain_a_star_and_nothing(spark):
    edges = [(i + 1, i) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 109), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
