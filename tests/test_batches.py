"""Table functions that take batches of columns: the same results as row by row."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from docgrowth.functions import plugged

DATA = "/root/testdata/sf0.001"
KINDS = "id int, big long, x double, small float, ok boolean, t string, d date, m decimal(20,3), count short"
ROWS = [
    (1, 2**63 - 1, 1.5, 0.1, True, "a", datetime.date(2024, 2, 29), Decimal("1.500"), 7),
    (2, None, None, None, None, None, None, None, None),
    (3, -(2**63), float("nan"), float("inf"), False, "", datetime.date(1, 1, 1), Decimal("-0.001"), -1),
    (4, 2**53 + 1, -0.0, -1.0, True, "é\n", datetime.date(9999, 12, 31), Decimal("99999999999999999.999"), 0),
]


@pytest.fixture
def kinds(spark):
    """The rows four times over, in two tasks and batches of three."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = spark.createDataFrame([*ROWS] * 4, KINDS).repartition(2)
    rows.createOrReplaceTempView("kinds")
    yield rows
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["judge_by_policy", "decide_by_rules", "buckets_by_strategy"])
def test_queries_send_batches_of_columns(spark, name):
    plan = _plan(entry_point.queries()[name](spark, DATA))
    assert "ArrowEvalPythonUDTF" in plan and "BatchEvalPythonUDTF" not in plan


def test_a_policy_sees_the_same_rows_in_batches(spark, kinds):
    policies = {
        "all": lambda r: repr((r.id, r.big, r["x"], r.small, r.ok, r.t, r.d, r.m, r["count"], callable(r.count), r[1:3], "t" in r, "z" in r, len(r), r.asDict(), r)),
        "types": lambda r: " ".join(type(v).__name__ for v in r),
        "none": lambda r: r.t,
    }
    spark.udtf.register("by_row", plugged.judging(policies))
    spark.udtf.register("by_batch", plugged.judging(policies, rows=kinds.schema))
    for name in policies:
        one, other = (spark.sql(f"SELECT * FROM {f}(TABLE(kinds), '{name}')") for f in ("by_row", "by_batch"))
        assert one.schema == other.schema and "ArrowEvalPythonUDTF" in _plan(other)
        assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect())) and other.count() == 16


def test_rules_decide_the_same_in_batches(spark, kinds):
    rules = {"positive": lambda r: f"over {r.x}" if r.x is not None and r.x > 0 else None, "text": lambda r: r.t, "never": lambda r: None}
    spark.udtf.register("by_row", plugged.deciding(rules))
    spark.udtf.register("by_batch", plugged.deciding(rules, kinds.schema))
    one, other = (spark.sql(f"SELECT * FROM {f}(TABLE(kinds))") for f in ("by_row", "by_batch"))
    assert one.schema == other.schema and "ArrowEvalPythonUDTF" in _plan(other)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect())) and other.count() == 4 + 3 * 4
    assert spark.sql("SELECT * FROM by_batch(TABLE(SELECT * FROM kinds WHERE id = 2))").count() == 0


def test_other_tables_and_names(spark, kinds):
    spark.udtf.register("by_batch", plugged.judging({"half": lambda r: "x"}, rows=kinds.schema))
    assert spark.sql("SELECT * FROM by_batch(TABLE(SELECT * FROM kinds WHERE id > 9), 'half')").count() == 0
    with pytest.raises(Exception, match="name one of"):
        spark.sql("SELECT * FROM by_batch(TABLE(kinds), 'none')").collect()
    with pytest.raises(Exception, match="made for rows of"):
        spark.sql("SELECT * FROM by_batch(TABLE(SELECT big AS a, * EXCEPT (big) FROM kinds), 'half')").collect()
    timed = kinds.select("id", F.timestamp_seconds("id").alias("at"))
    timed.createOrReplaceTempView("timed")
    spark.udtf.register("by_time", plugged.judging({"zone": lambda r: str(r.at.tzinfo)}, rows=timed.schema))
    assert {r["status"] for r in spark.sql("SELECT * FROM by_time(TABLE(timed), 'zone')").collect()} == {"None"}


def test_lists_of_values_are_counted(spark, kinds):
    signs = {"sign": (["below", "zero", "above"], lambda v: "below" if v < 0 else "zero" if v == 0 else "above" if v < 9 else None)}
    lists = spark.createDataFrame([(("a", 1), [-1.0, 5.0, None, 9.0]), (("a", 2), []), (("b", 1), None), (("c", 1), [None]), (None, [0.0, 0.0, -0.0])], "k struct<name: string, part: int>, v array<double>").coalesce(1)
    lists.createOrReplaceTempView("lists")
    spark.udtf.register("b", plugged.bucketing(signs, lists.schema))
    got = {(r["k"] and tuple(r["k"]), r["bucket"]): r["n"] for r in spark.sql("SELECT * FROM b(TABLE(lists), 'sign')").collect()}
    some = {(("a", 1), "below"): 1, (("a", 1), "above"): 1, (None, "zero"): 3}
    assert got == {(k, s): some.get((k, s), 0) for k in [("a", 1), ("a", 2), ("b", 1), ("c", 1), None] for s in ("below", "zero", "above")}
    with pytest.raises(Exception, match="name one of"):
        spark.sql("SELECT * FROM b(TABLE(lists), 'none')").collect()
    with pytest.raises(ValueError, match="a key and a list"):
        plugged.bucketing(signs, kinds.schema)
