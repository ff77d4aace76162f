"""Column values as Python objects that hash, compare and order as Spark's do: exact integers, null, NaN, structs."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAN = float("nan")  # one object, so that NaN equals itself


def plain(v):
    """Structs and arrays as tuples; any NaN as the same one."""
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return NAN if isinstance(v, float) and v != v else v


def rank(v):
    """A sort key: nulls first, NaN last, structs field by field."""
    if v is None:
        return (0,)
    if isinstance(v, tuple):
        return (1, tuple(rank(x) for x in v))
    return (2,) if v is NAN or v != v else (1, v)


def rows_of(columns: Sequence[pa.Array]) -> list[tuple]:
    """The columns' rows, without a detour over floats."""
    return list(zip(*([plain(v) for v in c.to_pylist()] for c in columns)))


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl), timestamp_utc=True)


def columns_of(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    """Arrow columns of a schema; a struct may come as a tuple."""
    if not rows:
        return [pa.array([], f.type) for f in schema]
    return [pa.array([_shaped(v, f.type) for v in c], f.type) for c, f in zip(zip(*rows), schema)]


def _shaped(v, kind: pa.DataType):
    if isinstance(v, tuple) and pa.types.is_struct(kind):
        return {kind.field(i).name: _shaped(x, kind.field(i).type) for i, x in enumerate(v)}
    if isinstance(v, tuple) and pa.types.is_list(kind):
        return [_shaped(x, kind.value_type) for x in v]
    return v
