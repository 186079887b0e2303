"""Users' own rules as table functions: judges, bucket strategies and decisions, for SQL and for DataFrames.

Each maker takes the user's functions by name and returns a table function that `spark.udtf.register` makes known
to SQL. The functions are plain Python and travel with the query. Where a rule can be said as a Column, the
operators that take Columns (`documents.rule_decisions`, `quality.layer_validation`) need no Python worker.

A table function that is not told its rows' schema takes any table, row by row. One that is told it (`rows`) takes
tables of these columns only, but as batches of Arrow columns, which costs a fraction of the time a row; the functions
see the same Rows. Only there a wrong name is found when the query runs, not before. Tables with columns other than
numbers, strings, booleans and dates go row by row all the same: Arrow would give other values (times with a zone).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, arrow_udtf, udtf
from pyspark.sql.types import ArrayType, BooleanType, DateType, LongType, NumericType, StringType, StructType


def _known(name: Any, functions: dict[str, Any]) -> None:
    if not isinstance(name, str) or name not in functions:
        raise ValueError(f"name one of {sorted(functions)}")


def _and(rows: StructType, *more: tuple[str, Any]) -> StructType:
    made = StructType([*rows.fields])
    for name, kind in more:
        made = made.add(name, kind)
    return made


def _with(rows: AnalyzeArgument, *more: tuple[str, Any]) -> StructType:
    if not rows.isTable:
        raise ValueError("the first argument is a table: TABLE(...)")
    return _and(rows.dataType, *more)


# --- batches of columns as Rows


def _in_batches(rows: StructType | None) -> bool:
    """Whether the schema is told and Arrow gives all its values as Rows hold them."""
    return rows is not None and all(isinstance(f.dataType, (NumericType, BooleanType, StringType, DateType)) for f in rows)


def _values(column: pa.Array) -> list:
    """A column's Python values; numpy makes them several times faster than `to_pylist`, but has no nulls among numbers."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    found = column.fill_null(pa.scalar(False).cast(kind)).to_numpy(zero_copy_only=False).astype(object)
    found[column.is_null().to_numpy(zero_copy_only=False)] = None
    return found.tolist()


def _rows_of(batch: pa.RecordBatch, names: list[str]) -> Iterator[Row]:
    """A batch's rows, as Rows that find a field without searching its name."""
    if batch.schema.names != names:
        raise ValueError(f"made for rows of {names}, not {batch.schema.names}")
    found = type("Row", (Row,), {"__fields__": names} | {n: property(itemgetter(i)) for i, n in enumerate(names) if not hasattr(Row, n) and not n.startswith("__")})
    return (tuple.__new__(found, values) for values in zip(*map(_values, batch.columns), strict=True))


# --- makers of table functions


def judging(policies: dict[str, Callable[[Row], str | None]], column: str = "status", rows: StructType | None = None):
    """judge(TABLE(rows), 'policy'): every row with the verdict of the policy named."""
    if _in_batches(rows):
        made, names = _and(rows, (column, StringType())), rows.names

        class JudgeBatches:
            def eval(self, batch: pa.RecordBatch, policy: pa.Array) -> Iterator[pa.RecordBatch]:
                if batch.num_rows:
                    _known(policy[0].as_py(), policies)
                    judge = policies[policy[0].as_py()]
                    verdicts = pa.array([judge(r) for r in _rows_of(batch, names)], pa.string())
                    yield pa.RecordBatch.from_arrays([*batch.columns, verdicts], names=made.names)

        return arrow_udtf(JudgeBatches, returnType=made)

    class Judge:
        @staticmethod
        def analyze(rows: AnalyzeArgument, policy: AnalyzeArgument) -> AnalyzeResult:
            _known(policy.value, policies)
            return AnalyzeResult(_with(rows, (column, StringType())))

        def eval(self, rows: Row, policy: str) -> Iterator[tuple]:
            yield *rows, policies[policy](rows)

    return udtf(Judge)


def deciding(rules: dict[str, Callable[[Row], str | None]], rows: StructType | None = None):
    """decide(TABLE(rows)): a row for each rule that decides something (not None) about a row, with the rule's name."""
    if _in_batches(rows):
        made, names = _and(rows, ("rule", StringType()), ("decision", StringType())), rows.names

        class DecideBatches:
            def eval(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                found = [(i, name, d) for i, r in enumerate(_rows_of(batch, names)) for name, rule in rules.items() if (d := rule(r)) is not None]
                at, by, decisions = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int32())).columns, pa.array(by, pa.string()), pa.array(decisions, pa.string())], names=made.names)

        return arrow_udtf(DecideBatches, returnType=made)

    class Decide:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(_with(rows, ("rule", StringType()), ("decision", StringType())))

        def eval(self, rows: Row) -> Iterator[tuple]:
            for name, rule in rules.items():
                decision = rule(rows)
                if decision is not None:
                    yield *rows, name, decision

    return udtf(Decide)


def bucketing(strategies: dict[str, tuple[list[str], Callable[[float], str | None]]], rows: StructType | None = None):
    """buckets(TABLE(rows) PARTITION BY key, 'strategy'): (key, bucket, n) with all of the strategy's buckets, empty ones too.

    `rows` has the key and a value; a strategy is its buckets in order and a function from a value to one of them (None:
    not counted, nor are null values). Only the counts are kept, so a partition may be of any size. Without PARTITION BY
    all rows go to one task; give the whole table a key that spreads, and add up.

    Told its schema, it takes a key and a list of values in each row, without PARTITION BY, and counts each row for itself:
    buckets(TABLE(SELECT key, collect_list(value) ...), 'strategy'). A list has to fit a worker.
    """
    if rows is not None:
        if len(rows) != 2 or not isinstance(rows[1].dataType, ArrayType) or not _in_batches(StructType().add("value", rows[1].dataType.elementType)):
            raise ValueError("rows are a key and a list of numbers, strings, booleans or dates")
        made = StructType([rows[0]]).add("bucket", StringType()).add("n", LongType())

        class BucketBatches:
            def eval(self, batch: pa.RecordBatch, strategy: pa.Array) -> Iterator[pa.RecordBatch]:
                if batch.num_rows:
                    _known(strategy[0].as_py(), strategies)
                    order, of = strategies[strategy[0].as_py()]
                    counts: list[int] = []
                    for values in batch.column(1):
                        found = Counter(of(v) for v in _values(values.values) if v is not None) if values.is_valid else {}
                        counts += (found.get(b, 0) for b in order)
                    at = pa.array([i for i in range(batch.num_rows) for _ in order], pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(order * batch.num_rows, pa.string()), pa.array(counts, pa.int64())], names=made.names)

        return arrow_udtf(BucketBatches, returnType=made)

    class Buckets:
        def __init__(self) -> None:
            self.counts: Counter = Counter()
            self.key: Any = None
            self.order: list[str] = []

        @staticmethod
        def analyze(rows: AnalyzeArgument, strategy: AnalyzeArgument) -> AnalyzeResult:
            _known(strategy.value, strategies)
            key = _with(rows).fields[0]
            return AnalyzeResult(StructType().add(key.name, key.dataType).add("bucket", StringType()).add("n", LongType()))

        def eval(self, rows: Row, strategy: str) -> None:
            self.key = rows[0]
            self.order, of = strategies[strategy]
            if rows[1] is not None:
                self.counts[of(rows[1])] += 1

        def terminate(self) -> Iterator[tuple]:
            for bucket in self.order:
                yield self.key, bucket, self.counts[bucket]

    return udtf(Buckets)
