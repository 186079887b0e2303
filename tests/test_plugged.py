"""Users' table functions, sources and sinks, bit sets and sketches."""

from __future__ import annotations

import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from docgrowth.functions import plugged
from docgrowth.operators import quality as q
from docgrowth.plans.views import Views
from docgrowth.sources import files
from docgrowth.streaming import operators as o

DATA = "/root/testdata/sf0.001"


def test_judges_and_their_names(spark):
    spark.udtf.register("j", plugged.judging({"over": lambda r: None if r.x is None else "big" if r.x > 2 else "small"}, column="size"))
    rows = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "id int, x int")
    rows.createOrReplaceTempView("judged_rows")
    got = spark.sql("SELECT * FROM j(TABLE(judged_rows), 'over')")
    assert got.columns == ["id", "x", "size"] and {r["id"]: r["size"] for r in got.collect()} == {1: "small", 2: "big", 3: None}
    with pytest.raises(Exception, match="name one of"):
        spark.sql("SELECT * FROM j(TABLE(judged_rows), 'none')").collect()
    assert spark.sql("SELECT * FROM j(TABLE(SELECT * FROM judged_rows WHERE id > 9), 'over')").count() == 0


def test_buckets_keep_empty_ones(spark):
    spark.udtf.register("b", plugged.bucketing({"sign": (["below", "zero", "above"], lambda v: "below" if v < 0 else "zero" if v == 0 else None)}))
    spark.createDataFrame([("a", -1.0), ("a", 5.0), ("a", None), ("c", 0.0)], "k string, v double").createOrReplaceTempView("bucket_rows")
    got = {(r["k"], r["bucket"]): r["n"] for r in spark.sql("SELECT * FROM b(TABLE(bucket_rows) PARTITION BY (k), 'sign')").collect()}
    assert got == {("a", "below"): 1, ("a", "zero"): 0, ("a", "above"): 0, ("c", "below"): 0, ("c", "zero"): 1, ("c", "above"): 0}


def test_rules_decide_once_or_more_or_not(spark):
    spark.udtf.register("dec", plugged.deciding({"odd": lambda r: "odd" if r.x % 2 else None, "large": lambda r: f"over {r.x - 1}" if r.x > 2 else None}))
    spark.createDataFrame([(1,), (2,), (3,)], "x int").createOrReplaceTempView("rule_rows")
    assert sorted((r["x"], r["rule"], r["decision"]) for r in spark.sql("SELECT * FROM dec(TABLE(rule_rows))").collect()) == [(1, "odd", "odd"), (3, "large", "over 2"), (3, "odd", "odd")]


def test_collections_come_back_and_corrupt_lines_stay(spark, tmp_path):
    files.register(spark)
    path = str(tmp_path / "collection")
    rows = spark.createDataFrame([(1, 1, "a", 'x"y\nz'), (2, 2, None, None), (3, 3, "b", "é")], "id long, seq long, tag string, payload string").repartition(2)
    rows.write.format("evidence").mode("append").save(path)
    read = spark.read.format("evidence").load(path)
    assert sorted(map(tuple, read.drop("_corrupt").collect())) == sorted(map(tuple, rows.collect()))
    with open(f"{path}/by-hand.jsonl", "w") as f:
        f.write('{"id": 4, "seq": 4}\nnot json\n{"id": "five"}\n\n[1]\n')
    got = spark.read.format("evidence").option("groupBytes", 1).load(path)
    assert sorted(r["_corrupt"] for r in got.filter("_corrupt is not null").collect()) == ["[1]", "not json", '{"id": "five"}'] and got.filter("id is not null").count() == 4
    assert spark.read.format("evidence").schema("id long, seq long").load(path).count() == 4 and got.rdd.getNumPartitions() >= 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kept = spark.read.format("evidence").option("pushdown", "true").load(path).filter("tag = 'a'")
    assert [r["id"] for r in kept.collect()] == [1]
    spark.createDataFrame([(9, 9, None, None)], rows.schema).write.format("evidence").mode("overwrite").save(path)
    assert [r["id"] for r in spark.read.format("evidence").load(path).collect()] == [9]
    assert spark.read.format("evidence").load(str(tmp_path / "nothing")).count() == 0


def test_a_failed_write_leaves_nothing_to_see(spark, tmp_path):
    files.register(spark)
    path = str(tmp_path / "failed")
    bad = spark.range(100).repartition(4).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("seq"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("evidence").mode("append").save(path)
    assert [n for n in os.listdir(path) if not n.startswith("_")] == [] and spark.read.format("evidence").load(path).count() == 0


def test_parts_of_a_sitemap_and_other_lines(spark, tmp_path):
    files.register(spark)
    path = str(tmp_path / "map")
    spark.range(25).selectExpr("concat('https://a.example/', id, '?a&b') AS loc", "if(id = 3, null, '2024-01-01') AS lastmod").coalesce(1).write.format("sitemap").options(rowsPerFile="10", base="https://a.example/maps/").mode("append").save(path)
    parts = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    texts = [open(f"{path}/{n}").read() for n in parts]
    assert [t.count("<url>") for t in texts] == [10, 10, 5] and all(t.startswith("<?xml") and t.endswith("</urlset>\n") for t in texts) and "?a&amp;b</loc></url>" in texts[0]
    index = open(f"{path}/sitemap_index.xml").read()
    assert index.count("<sitemap>") == 3 and all(f"<loc>https://a.example/maps/{n}</loc>" in index for n in parts)
    spark.createDataFrame([(["a", 'b"c', ""],), ([],), (None,)], "cells array<string>").coalesce(1).write.format("csvlines").mode("append").save(str(tmp_path / "csv"))
    assert sorted(spark.read.text(str(tmp_path / "csv")).collect())[-1][0] == '"a","b""c",""'
    spark.createDataFrame([(1, "x|y"), (None, "z")], "n int, t string").coalesce(1).write.format("report").option("title", "T").mode("append").save(str(tmp_path / "md"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "md")).collect()] == ["# T", "", "| n | t |", "|---|---|", "| 1 | x\\|y |", "|  | z |"]


def test_pairs_of_documents_that_share_a_cause(spark):
    failures = q.failure_dimensions(Views(spark, DATA).glyph_diffs)
    sets = {}
    for r in failures.select("doc", "root").distinct().collect():
        sets.setdefault(r["doc"], set()).add(r["root"])
    want = {(a, b): sets[a] & sets[b] for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}
    pairs, members = q.shared_root_pairs(failures)
    inside = {}
    for r in members.collect():
        inside.setdefault(r["class"], []).append(r["doc"])
    got, total = {}, 0
    for r in pairs.collect():
        both = [(a, b) for a in inside[r["class_a"]] for b in inside[r["class_b"]] if a != b]
        made = {tuple(sorted(x)): {*r["shared"].split(",")} for x in both}
        assert len(made) == r["pairs"] and r["documents"] == len({*inside[r["class_a"]], *inside[r["class_b"]]})
        total += len(made)
        got |= made
    assert got == want and total == len(want)


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(300_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 2).alias("category"), F.when(F.col("id") % 5 > 0, F.pow(F.rand(3), 3) * 100).alias("after_delta"))
    daily = q.replay_sketches(rows, ["category", "day"])
    stats = {r["category"]: r for r in q.sketched_stats(daily, ["category"]).collect()}
    for c in (0, 1):
        values = sorted(r[0] for r in rows.filter(F.col("category") == c).dropna().select("after_delta").collect())
        assert stats[c]["n"] == len(values) and stats[c]["rows"] == 150_000
        for name, at in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            rank = sum(v <= stats[c][name] for v in values) / len(values)
            assert abs(rank - at) <= q.RANK_ERROR
    small = q.sketched_stats(q.replay_sketches(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", None)], "category string, after_delta double"), ["category"]), ["category"])
    assert {r["category"]: (r["n"], r["p50"]) for r in small.collect()} == {"a": (3, 2.0), "b": (0, None)}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table = o.KeyedTable(spark, str(tmp_path / "keyed"), spark.createDataFrame([], "k int, n int").schema, ["k"])
    batch = lambda *rows: spark.createDataFrame([*rows], "k int, n int")
    now = lambda: sorted(map(tuple, table.read().collect()))
    assert now() == []
    table.write(batch((1, 1), (2, 1)), 0)
    table.write(batch((2, 5)), 1)
    assert now() == [(1, 1), (2, 5)]
    table.write(batch((2, 5)), 1)
    assert now() == [(1, 1), (2, 5)]
    table.write(batch((3, 7), (2, 6)), 10)
    assert now() == [(1, 1), (2, 6), (3, 7)]
    table.compact(10)
    assert now() == [(1, 1), (2, 6), (3, 7)] and table.batches() == [10]
    table.write(batch((1, 9)), 11)
    assert now() == [(1, 9), (2, 6), (3, 7)]


def test_update_mode_writes_changed_keys_only(spark, tmp_path):
    for n, rows in enumerate([[(0, "view"), (1, "view")], [(1, "click")], [(1, "view"), (2, "view")]]):
        spark.createDataFrame(rows, "variant long, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/batch-{n}"))
    stream = spark.readStream.schema("variant long, event_type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/batch-*"))
    counts = o.ab_counts(stream)
    table = o.KeyedTable(spark, str(tmp_path / "out"), counts.schema, ["variant"])
    counts.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(table.write).start().awaitTermination()
    sizes = {n: spark.read.parquet(str(tmp_path / f"out/in_batch={n}")).count() for n in table.batches()}
    assert sum(sizes.values()) == 2 + 1 + 2 and sorted(map(tuple, table.read().collect())) == [(0, 1, 0), (1, 2, 1), (2, 1, 0)]
    assert sorted(map(tuple, o.updated(counts, ["variant"]).collect())) == [(0, 1, 0), (1, 2, 1), (2, 1, 0)]


def test_rows_of_json_are_lines(spark, tmp_path):
    files.register(spark)
    spark.createDataFrame([(1, True, 2.0)], "id long, ok boolean, x double").coalesce(1).write.format("evidence").mode("append").save(str(tmp_path / "j"))
    [name] = [n for n in os.listdir(tmp_path / "j") if n.endswith(".jsonl")]
    assert json.loads(open(tmp_path / "j" / name).read()) == {"id": 1, "ok": True, "x": 2.0}
    assert spark.read.format("evidence").schema("id long, ok boolean, x double").load(str(tmp_path / "j")).first() == (1, True, 2.0)
