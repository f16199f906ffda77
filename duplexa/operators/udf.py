"""User code: typed functions, a counting aggregate, map and reduce."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


class TypedFunction:
    """A function of typed arguments. ``takes`` are SQL types; a null argument gives null; integers keep their 64 bits.

    Arity is checked against the function's own signature when it is made, arity and types of the arguments when it is
    applied to a table's columns, before anything runs.
    """

    def __init__(self, function: Callable, takes: list[str], returns: str):
        kinds = [p.kind for p in inspect.signature(function).parameters.values()]
        if inspect.Parameter.VAR_POSITIONAL not in kinds and len(kinds) != len(takes):
            raise TypeError(f"the function has {len(kinds)} arguments, {len(takes)} types are given")
        parsed = [T.StructType.fromDDL(f"x {t}")["x"].dataType for t in [*takes, returns]]
        self.takes, self.returns = parsed[:-1], parsed[-1]
        kind = to_arrow_type(self.returns)

        @F.arrow_udf(self.returns)
        def wrapped(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in batches:
                # distinct argument tuples without a null are computed once a batch
                known: dict = {}
                out = []
                for row in zip(*(c.to_pylist() for c in columns), strict=True):
                    if row not in known:
                        known[row] = None if any(x is None for x in row) else function(*row)
                    out.append(known[row])
                yield pa.array(out, kind)

        self.wrapped = wrapped

    def __call__(self, df: DataFrame, *columns: str) -> Column:
        if len(columns) != len(self.takes):
            raise TypeError(f"{len(self.takes)} arguments are taken, {len(columns)} given")
        for c, kind in zip(columns, self.takes, strict=True):
            if df.schema[c].dataType != kind:
                raise TypeError(f"column {c} is {df.schema[c].dataType.simpleString()}, {kind.simpleString()} is taken")
        return self.wrapped(*[F.col(c) for c in columns])


def register(spark: SparkSession, name: str, function: Callable, takes: list[str], returns: str) -> TypedFunction:
    """A typed function, and the same for SQL under a name."""
    typed = TypedFunction(function, takes, returns)
    spark.udf.register(name, typed.wrapped)
    return typed


def map_reduce(rows: DataFrame, mapper: Callable, pairs: str, reducer: Callable, returns: str, combine: bool = False) -> DataFrame:
    """User code over keys: ``mapper`` gives (key, value) pairs of a row, ``reducer`` gives rows of a key and its values.

    ``pairs`` is the schema of key and value, ``returns`` that of the reducer's rows. With ``combine`` the reducer must give
    (key, value) pairs itself and is applied to each batch of pairs before the shuffle as well.
    """
    schema = T.StructType.fromDDL(pairs)
    key, value = schema.names
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    result = T.StructType.fromDDL(returns)
    final = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in result.fields])

    def table(found: list, kinds: pa.Schema) -> pa.Table:
        return pa.table([pa.array([x[i] for x in found], f.type) for i, f in enumerate(kinds)], schema=kinds)

    def run(batches):
        for batch in batches:
            found = [p for row in batch.to_pylist() for p in mapper(row)]
            if combine:
                held: dict = {}
                for k, v in found:
                    held.setdefault(k, []).append(v)
                found = [p for k, v in held.items() for p in reducer(k, v)]
            yield from table(found, arrow).to_batches()

    def reduce(group, values):
        return table(list(reducer(group[0].as_py(), values.column(value).to_pylist())), final)

    return rows.mapInArrow(run, schema).groupBy(key).applyInArrow(reduce, result)


def counter(bag: DataFrame, key: str, value: str, limit: int = 0) -> DataFrame:
    """(key, bag): each distinct value of a key with its count, those at or above the limit; two levels, both combined early."""
    counts = bag.groupBy(key, value).agg(F.count("*").alias("count")).where(F.col("count") >= limit)
    return counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(value, "count"))).alias("bag"))
