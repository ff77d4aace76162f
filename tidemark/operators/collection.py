"""Operators on one collection: records with a signed multiplicity.

Linear operators are plain projections and add no shuffle.  ``consolidate`` and the aggregates
group once, and Spark combines partial sums before the shuffle, so a hot record costs no more than
one row a task.  On a trace the version columns are columns like others and stay in the record.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.values import arrow_schema, columns_of, rank, rows_of
from tidemark.sources import M


def _record(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != M]


def map_records(df: DataFrame, *exprs: Column | str, versions: Sequence[str] = ()) -> DataFrame:
    """Each record transformed; multiplicity and version columns are carried along."""
    return df.select(*exprs, *versions, M)


def filter_records(df: DataFrame, predicate: Column) -> DataFrame:
    """Records for which the predicate is true; false and null drop."""
    return df.where(predicate)


def negate(df: DataFrame) -> DataFrame:
    return df.withColumn(M, -F.col(M))


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Additive union."""
    return a.unionByName(b)


def consolidate(df: DataFrame) -> DataFrame:
    """One row a record with its net multiplicity; zeros drop."""
    return df.groupBy(*_record(df)).agg(F.sum(M).alias(M)).where(F.col(M) != 0).select(*df.columns)


def in_order(df: DataFrame) -> DataFrame:
    """Consolidated records in ascending order, for a sink."""
    return consolidate(df).orderBy(*_record(df))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The signed change that leads from ``b`` to ``a``."""
    return consolidate(concat(a, negate(b)))


def join(a: DataFrame, b: DataFrame, key: Sequence[str], null_keys: bool = True) -> DataFrame:
    """Inner equi-join; multiplicities multiply.

    Null keys match unless ``null_keys`` is off, which saves an exchange where keys are known not
    to be null.  Clashing value columns of ``b`` get the suffix ``_right``.
    """
    taken = set(a.columns) - {M}
    right = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
                     *[F.col(c).alias(c if c not in taken else f"{c}_right") for c in b.columns if c not in (*key, M)],
                     F.col(M).alias("_m"))
    on = None
    for i, k in enumerate(key):
        same = a[k].eqNullSafe(right[f"_k{i}"]) if null_keys else a[k] == right[f"_k{i}"]
        on = same if on is None else on & same
    values = [c for c in right.columns if not c.startswith("_k") and c != "_m"]
    return a.join(right, on, "inner").select(*_record(a), *values, (F.col(M) * F.col("_m")).alias(M))


def semijoin(a: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Join against bare keys: multiplicities multiply, so a doubled key doubles its records."""
    return join(a, keys.select(*key, M), key)


def count(df: DataFrame, key: Sequence[str], drop_zero_keys: bool = False) -> DataFrame:
    """Net multiplicity a key; keys whose records cancel keep a row with 0."""
    return _weighted(df, key, F.col(M), "count", drop_zero_keys)


def sum_values(df: DataFrame, key: Sequence[str], value: str, drop_zero_keys: bool = False) -> DataFrame:
    """Sum of value times multiplicity a key; null values add nothing."""
    return _weighted(df, key, F.col(value) * F.col(M), "sum", drop_zero_keys)


def _weighted(df: DataFrame, key: Sequence[str], term: Column, name: str, drop_zero_keys: bool) -> DataFrame:
    out = df.groupBy(*key).agg(F.coalesce(F.sum(term), F.lit(0)).alias(name), F.sum(M).alias("_net"))
    if drop_zero_keys:
        out = out.where("_net <> 0")
    return out.select(*key, name, F.lit(1).cast("bigint").alias(M))


def not_negative(net: Column) -> Column:
    return F.when(net < 0, F.raise_error(F.lit("negative net multiplicity"))).otherwise(net)


def _present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.sum(M).alias("_net")).where(not_negative(F.col("_net")) > 0)


def min_value(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Least value present a key (structs compare field by field); vanished keys have no row."""
    return _present(df, [*key, value]).groupBy(*key).agg(F.min(value).alias("min")).select(*key, "min", F.lit(1).cast("bigint").alias(M))


def max_value(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    return _present(df, [*key, value]).groupBy(*key).agg(F.max(value).alias("max")).select(*key, "max", F.lit(1).cast("bigint").alias(M))


def distinct(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Multiplicity 1 for each record that is present."""
    cols = list(cols or _record(df))
    return _present(df, cols).select(*cols, F.lit(1).cast("bigint").alias(M))


def reduce_groups(df: DataFrame, key: Sequence[str], value: Sequence[str],
                  f: Callable[[list[tuple[tuple, int]]], list[tuple[tuple, int]]], schema: str) -> DataFrame:
    """``f`` maps a key's weighted values to weighted results; ``schema`` names the results' columns.

    Values are consolidated first, so a group holds its distinct values and not its rows; one
    group's distinct values must fit a task, as ``f`` wants them together.  ``f`` sees them in order,
    nulls first and integers exact.
    """
    types = dict(df.dtypes)
    spec = ", ".join([*(f"`{k}` {types[k]}" for k in key), schema, f"{M} bigint"])
    shape = arrow_schema(spec)

    def run(group: pa.Table) -> pa.Table:
        ids = rows_of([group.column(k).slice(0, 1) for k in key])[0] if key else ()
        weighted = sorted(zip(rows_of([group.column(v) for v in value]), group.column(M).to_pylist()), key=lambda e: rank(e[0]))
        return pa.Table.from_arrays(columns_of([(*ids, *result, m) for result, m in f(weighted)], shape), schema=shape)

    bare = consolidate(df.select(*key, *value, M))
    return bare.groupBy(*key).applyInArrow(run, spec)
