"""Workload jobs, and the traces over the test tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators import collection as C, trace as T
from tidemark.sources import M, collection, trace


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _months(ts):
    return ((F.year(ts) - 1995) * 12 + F.month(ts) - 1).cast("int")


def event_log(spark, sf_dir) -> DataFrame:
    """key user_id, value event_type, version day; insert-only."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"),
                                             F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("version"))
    return trace(e, F.col("version")).select("key", "value", M, "version")


def event_signed(spark, sf_dir) -> DataFrame:
    """As event_log, with -1 for errors: nets may be negative."""
    return event_log(spark, sf_dir).withColumn(M, F.when(F.col("value") == "error", -1).otherwise(1).cast("bigint"))


def orders_base(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("value"),
        _months(F.col("o_orderdate")).alias("version"), "o_orderstatus", "o_orderdate", "o_orderpriority")


def order_churn(spark, sf_dir) -> DataFrame:
    """key custkey, value cents, +1 in the order's month and -1 six months later if filled."""
    o = orders_base(spark, sf_dir)
    gone = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit(0).alias("d"), F.lit(1).alias("m")), F.struct(F.lit(6).alias("d"), F.lit(-1).alias("m")))
                  ).otherwise(F.array(F.struct(F.lit(0).alias("d"), F.lit(1).alias("m"))))
    return o.select("key", "value", "version", F.explode(gone).alias("x")).select(
        "key", "value", F.col("x.m").cast("bigint").alias(M), (F.col("version") + F.col("x.d")).alias("version"))


def order_churn2(spark, sf_dir) -> DataFrame:
    """key custkey, value cents, product version (year, priority digit)."""
    o = orders_base(spark, sf_dir)
    return collection(o.select("key", "value", (F.year("o_orderdate") - 1995).alias("v0"), F.substring("o_orderpriority", 1, 1).cast("int").alias("v1"))).select("key", "value", M, "v0", "v1")


def line_trace(spark, sf_dir) -> DataFrame:
    """key orderkey, value line number, version ship month; a multiset."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("value"), _months(F.col("l_shipdate")).alias("version"))
    return trace(li, F.col("version")).select("key", "value", M, "version")


def order_trace(spark, sf_dir) -> DataFrame:
    """key orderkey, value custkey, version order month."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"), _months(F.col("o_orderdate")).alias("version"))
    return trace(o, F.col("version")).select("key", "value", M, "version")


def grid_cells(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return collection(li.select((F.col("l_partkey") % 200).cast("int").alias("x"), (F.col("l_suppkey") % 100).cast("int").alias("y")).distinct())


def every_cell(spark, sf_dir) -> DataFrame:
    """A cell for each part and supplier of a line item."""
    li = read(spark, sf_dir, "lineitem")
    return collection(li.select(F.col("l_partkey").cast("int").alias("x"), F.col("l_suppkey").cast("int").alias("y")).distinct())


def grid_step(cells: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Cells with three neighbours, or with two that were there: one aggregate and one join.

    Eight shifted copies of each cell are exploded in place; cells and counts meet on the same
    columns.  ``carried`` columns (a version) take part in the key.
    """
    key = [*carried, "x", "y"]
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    near = cells.select(*carried, M, F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in around])).alias("n"))
    counts = C.count(near.select(*carried, "n.x", "n.y", M), key).drop(M)
    there = cells.select(*key, F.lit(True).alias("_there"))
    alive = counts.join(there, key, "left").where((F.col("count") == 3) | ((F.col("count") == 2) & F.col("_there")))
    return alive.select(*key, F.lit(1).cast("bigint").alias(M)).select(*cells.columns)


def closure_step(limit: int, step):
    """``x`` and what ``step`` makes of it, up to ``limit``, each once."""
    def f(df: DataFrame) -> DataFrame:
        nxt = df.withColumn("x", step(F.col("x")))
        return C.distinct(C.concat(df, nxt).where(F.col("x") <= limit)).select(*df.columns)
    return f


def reached(limit: int, step):
    """The linear part of ``closure_step``: ``x`` and what ``step`` makes of it, up to ``limit``."""
    return lambda df: C.concat(df, df.withColumn("x", step(F.col("x")))).where(F.col("x") <= limit)


def join_count(a: DataFrame, b: DataFrame, key: str = "key", null_keys: bool = True, versions: tuple[str, ...] = ("version",)) -> DataFrame:
    """Changes of the number of joined records a key, pre-aggregated; several ``versions`` are coordinates of a product order.

    A version whose changes cancel keeps its row, so that the key counts 0 and is not unknown.
    Null keys match each other; ``null_keys=False`` says that there are none, which saves an exchange.

    The count needs no values: each side shrinks to one net change for each (key, version) first,
    which keeps hot keys at one row a version; in product order these are joined.
    """
    if len(versions) == 1:
        left, right = (x.select(key, M, *versions, F.lit(i).alias("side")) for i, x in enumerate((a, b)))
        both = left.unionByName(right)
        return join_count_of_sides(both if null_keys else both.where(F.col(key).isNotNull()), key, *versions)
    left, right = (x.groupBy(key, *versions).agg(F.sum(M).alias(M)).select(key, M, *versions) for x in (a, b))
    return T.count_product(T.join_trace(left, right, [key], versions, null_keys), [key], versions)


def join_count_of_sides(both: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """``join_count`` of one table whose ``side`` is 0 or 1, in total order: no join, as a key's count is the product of both sides' running counts.

    It is known from the version on at which both sides have had a record.
    """
    counts = [F.sum(F.when(F.col("side") == i, F.col(M))).alias(f"_n{i}") for i in (0, 1)]
    w = Window.partitionBy(key).orderBy(version).rowsBetween(Window.unboundedPreceding, 0)
    running = both.groupBy(key, version).agg(*counts).select(key, version, (F.sum("_n0").over(w) * F.sum("_n1").over(w)).alias("count"))
    return T.changes_of(running.where("count is not null"), [key], "count", version)


def lines_per_customer(spark, sf_dir) -> DataFrame:
    """orders join lineitem on orderkey, line items counted by customer."""
    orders = collection(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer")))
    lines = C.consolidate(collection(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))))
    return C.count(C.join(orders, lines, ["key"], null_keys=False), ["customer"])
