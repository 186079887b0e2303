"""Queries over whole tables."""

from __future__ import annotations

import __spark_entry__ as entry_point
from docgrowth.operators import catalog as c
from docgrowth.operators import quality as q
from docgrowth.plans.views import Views

DATA = "/root/testdata/sf0.001"


def test_pipeline_report_covers_all_keywords(spark):
    want = c.keyword_discovery(Views(spark, DATA).keywords).count()
    assert entry_point.queries()["pipeline_report"](spark, DATA).first()["phrases"] == want


def test_replay_dashboard_nests_its_parts(spark):
    judged = q.replay_judge(Views(spark, DATA).replays)
    [row] = entry_point.queries()["replay_dashboard"](spark, DATA).collect()
    assert row["stats"] == q.replay_stats(judged).collect() and row["histogram"] == q.delta_histogram(judged, "after_delta").collect()
    assert row["regressions"] == q.replay_regressions(judged, ("l_orderkey", "row")).collect() and len(row["regressions"]) == 10
    counted = judged.filter("after_delta >= 0").count()
    assert sum(b["n"] for b in row["histogram"]) == counted and row["stats"][0]["n"] == judged.count()


def test_replay_dashboard_of_nothing(spark):
    judged = q.replay_judge(Views(spark, DATA).replays.filter("false"))
    [row] = q.replay_dashboard(judged, ("l_orderkey", "row")).collect()
    assert row["stats"][0]["n"] == 0 and row["regressions"] == [] and [b["n"] for b in row["histogram"]] == [0] * 5
