"""Odd rows of the tables against DuckDB."""

from __future__ import annotations

import threading
from itertools import count

from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from docgrowth.operators import layout as h
from docgrowth.operators import similar as s

TEXTS = ["", " ", "  \n", "\n", "\n\n", "a", "a ", " a", "\ta", "a b", "a  b c", "a\nb", "a\n", "\na b", "a\x0bb", "\x0b", "a\x0b b\x0bc", "a\r", "\r\n", "a\fb", "a b", " ", "\x1c a", "é ñ", "a \x85", None]


def same(spark, tmp_path, name, table, found, keys):
    """The query's rows, equal to its SQL's, on a folder that has this table."""
    import duckdb

    found.write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(entry_point.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r[c] for c in columns) for r in entry_point.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str) and len(got) == keys
    return got


def test_paragraphs_of_blanks(spark, tmp_path):
    texts = [*enumerate(TEXTS), (5, "b c")]  # an id twice
    docs = spark.createDataFrame([(k, t, "en", "src") for k, t in texts], "doc_id long, text string, lang string, source string")
    same(spark, tmp_path, "split_paragraph", "documents", docs, len(TEXTS))
    rows = spark.createDataFrame([("a b c d", 3), (" a", 2), ("", 2), ("a\nb", 3)], "text string, lines int")
    got = [(r["text"], r["parts"], r["n"], r["part"]) for r in h.split_paragraph(rows).collect()]
    assert got == [("a b c d", 2, 0, "a b"), ("a b c d", 2, 1, "c d"), (" a", 2, 0, ""), (" a", 2, 1, "a"), ("", 1, 0, ""), ("a\nb", 2, 0, "a"), ("a\nb", 2, 1, "b")]


def test_spread_of_odd_quantities(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    orders = [[None], [None, None], [None, 4.0], [4.0], [0.0], [-3.0, 3.0], [0.0, -0.0], [nan], [nan, 2.0], [inf], [inf, 2.0], [-inf], [-inf, inf], [1e200, 1.2e200], [-4.0, -5.0], [2.0, 2.0], [1.0, 9.0]]
    rows = [(k, x, at) for k, order in [*enumerate(orders), (None, [1.0, 1.5])] for at, x in enumerate(order)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_linenumber int")
    rest = {"l_partkey": "long", "l_suppkey": "long", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string"}
    got = same(spark, tmp_path, "systematic", "lineitem", lines.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in rest.items())), len(orders) + 1)
    assert dict(got)[0] is None and dict(got)[2] and dict(got)[9]


def test_near_duplicates_of_odd_letters(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog and runs away"
    odd = ["İstanbul {}", "istanbul {}", "Kelvin {}", "kelvin\x0b{}", "ÇA {}", "ça, {}\r", "{} ß", "{} s", "{} s", "{}\x00s", "Ünder {}", "ǅ {}", "{} ΣΑΣ", "{} 😀 s", ""]
    texts = [t.format(base) for t in odd] + ["?", "a b", "A, b", "İ İx", "ix i", None]
    docs = spark.createDataFrame([(k, t, "en", "src") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = same(spark, tmp_path, "near_duplicates", "documents", docs, 93)
    assert (0, 1, 1.0) in got and (2, 3, 1.0) in got


def test_normalised_as_by_the_operators(spark):
    texts = [t for t in TEXTS if t is not None] + ["Ça va,  où?\x0b\tÀ É", "a--b__c", "ÿ Ø ł", "x y\x85z", "naïve CAFÉ 12.5%"]
    rows = spark.createDataFrame(enumerate(texts), "k int, x string").select("x", s.normalise(F.col("x")).alias("y")).collect()
    assert [s._normalised(r["x"]).decode() for r in rows] == [r["y"] for r in rows]


def test_a_stripe_is_fetched_while_another_is_compared(spark, monkeypatch):
    vocabulary = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(vocabulary[k % 20 : k % 20 + 8 + k % 5]) + f" x{k // 4}") for k in range(200)], "doc long, body string")
    begun, tables = [], []
    index, compared, write = s._index, s._compared, s.written
    next_one = threading.Condition()

    def one(stripe):
        with next_one:
            begun.append(threading.current_thread())
            next_one.notify_all()
        return index(stripe)

    def two(facts, held, least, at=count(2)):
        with next_one:
            wanted = min(next(at), stripes)
            assert next_one.wait_for(lambda: len(begun) >= wanted, timeout=60)
        return compared(facts, held, least)

    monkeypatch.setattr(s, "_index", one)
    monkeypatch.setattr(s, "_compared", two)
    monkeypatch.setattr(s, "written", lambda df, name: tables.append((name, df.columns)) or write(df, name))
    monkeypatch.setattr(s, "_HOT", 60)
    stripes = 4
    assert s.near_duplicates(docs, "doc", "body").count() > 0
    assert len(begun) >= stripes and threading.current_thread() not in begun
    assert tables[0] == ("named", ["k", "c", "z", "n", "h"]) and {name for name, _ in tables[1:]} == {"found"}  # texts are written once, compressed
