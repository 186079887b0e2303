"""Views and operators whose rows are dealt in proportion to the tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from docgrowth.plans import views

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["merge_short_lines", "grid_assign", "page_regression", "line_groups", "column_centres", "block_clusters", "dominant_font", "reading_order", "visual_right", "text_columns", "table_row_cells", "multi_column_lines"])
def test_pages_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch, name):
    monkeypatch.setattr(views, "LINES_A_TASK", 200)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert entry_point.queries()[name](spark, DATA).rdd.getNumPartitions() == -(-lines // 200)


def test_a_category_is_counted_in_parts(spark):
    found = entry_point.queries()["buckets_by_strategy"](spark, DATA)
    assert "xxhash64(l_orderkey" in found._jdf.queryExecution().analyzed().toString()
    assert {r["category"] for r in found.collect()} == {"A", "N", "R"} and found.count() == 12


def test_words_of_pages_are_joined_in_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(views, "LINES_A_TASK", 200)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert entry_point.queries()["word_trace"](spark, DATA).rdd.getNumPartitions() == -(-lines // 200)
