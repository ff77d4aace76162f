"""Registered queries over the test tables, each beside the DuckDB statement for the same rows.

Traces are written once as SQL common table expressions; a query's SQL names those that it uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tidemark import sources as S
from tidemark.functions import versions as V
from tidemark.operators import collection as C, incremental as N, iterate as I, trace as T
from tidemark.plans import jobs as J
from tidemark.scratch import new_folder
from tidemark.sources import M

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

MONTHS = "CAST((year({0}) - 1995) * 12 + month({0}) - 1 AS INTEGER)"
ONE = "CAST(1 AS BIGINT)"
_XYZ = ["v0", "v1", "v2"]
CTES = {
    "event_log": f"SELECT user_id AS key, event_type AS value, {ONE} AS multiplicity, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS version FROM events",
    "event_signed": "SELECT key, value, CAST(CASE WHEN value = 'error' THEN -1 ELSE 1 END AS BIGINT) AS multiplicity, version FROM event_log",
    "orders_base": f"SELECT o_custkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS value, {MONTHS.format('o_orderdate')} AS version, o_orderstatus, o_orderdate, o_orderpriority FROM orders",
    "order_churn": f"SELECT key, value, {ONE} AS multiplicity, version FROM orders_base UNION ALL SELECT key, value, CAST(-1 AS BIGINT), version + 6 FROM orders_base WHERE o_orderstatus = 'F'",
    "order_churn2": f"SELECT key, value, {ONE} AS multiplicity, CAST(year(o_orderdate) - 1995 AS INTEGER) AS v0, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS v1 FROM orders_base",
    "line_trace": f"SELECT l_orderkey AS key, l_linenumber AS value, {ONE} AS multiplicity, {MONTHS.format('l_shipdate')} AS version FROM lineitem",
    "order_trace": f"SELECT o_orderkey AS key, o_custkey AS value, {ONE} AS multiplicity, {MONTHS.format('o_orderdate')} AS version FROM orders",
    "grid_cells": f"SELECT DISTINCT CAST(l_partkey % 200 AS INTEGER) AS x, CAST(l_suppkey % 100 AS INTEGER) AS y, {ONE} AS multiplicity FROM lineitem",
}
NEEDS = {"event_signed": ["event_log"], "order_churn": ["orders_base"], "order_churn2": ["orders_base"]}


def sql(body: str, *ctes: str, more: str = "", recursive: bool = False) -> str:
    names: list[str] = []
    for c in ctes:
        names += [x for x in [*NEEDS.get(c, []), c] if x not in names]
    parts = [f"{n} AS ({CTES[n]})" for n in names] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body


def query(name: str, statement: str | None = None):
    def register(f):
        QUERIES[name] = f
        if statement:
            ORACLE[name] = statement
        return f
    return register


def _big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


# ---- sources and sinks -------------------------------------------------------------------------

@query("s1_collection", f"SELECT o_custkey AS key, o_orderstatus AS value, {ONE} AS multiplicity FROM orders")
def _(spark, d):
    return S.collection(J.read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("value")))


@query("s2_sequence", f"SELECT o_custkey AS key, {ONE} AS multiplicity, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS version FROM orders")
def _(spark, d):
    o = J.read(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return S.trace_from_sequence([S.collection(o.where(state == i).select(F.col("o_custkey").alias("key"))) for i in range(3)])


@query("s3_trace", sql("SELECT key, value, multiplicity, version FROM order_trace", "order_trace"))
def _(spark, d):
    return J.order_trace(spark, d)


@query("k1_tap", sql(f"SELECT key, {_big('sum(multiplicity)')} AS count, {ONE} AS multiplicity FROM event_signed GROUP BY key", "event_signed"))
def _(spark, d):
    return C.count(S.tap(J.event_signed(spark, d), "events"), ["key"])


@query("k2_deltas", sql(f"SELECT key, {_big('sum(multiplicity)')} AS multiplicity, version FROM event_log GROUP BY key, version", "event_log"))
def _(spark, d):
    path = new_folder(spark, "deltas")
    S.write_deltas(C.consolidate(J.event_log(spark, d).select("key", M, "version")), path)
    return spark.read.parquet(path).select("key", M, "version")


# ---- projection, filter, set operations --------------------------------------------------------

@query("l1_map", sql("SELECT value AS key, key % 10 AS value, version, multiplicity FROM event_log", "event_log"))
def _(spark, d):
    return C.map_records(J.event_log(spark, d), F.col("value").alias("key"), (F.col("key") % 10).alias("value"), versions=["version"])


@query("l2_filter", sql("SELECT key, value, multiplicity, version FROM event_log WHERE value <> 'click'", "event_log"))
def _(spark, d):
    return C.filter_records(J.event_log(spark, d), F.col("value") != "click")


@query("l3_negate", sql("SELECT key, value, -multiplicity AS multiplicity, version FROM event_signed", "event_signed"))
def _(spark, d):
    return C.negate(J.event_signed(spark, d))


@query("l4_concat", sql("SELECT * FROM event_log UNION ALL SELECT * FROM event_signed", "event_log", "event_signed"))
def _(spark, d):
    return C.concat(J.event_log(spark, d), J.event_signed(spark, d))


_CONSOLIDATED = f"SELECT key, value, {_big('sum(multiplicity)')} AS multiplicity FROM event_signed GROUP BY key, value HAVING sum(multiplicity) <> 0"


@query("l5_consolidate", sql(_CONSOLIDATED, "event_signed"))
def _(spark, d):
    return C.consolidate(J.event_signed(spark, d).drop("version"))


@query("l6_consolidate_trace", sql(f"SELECT key, {_big('sum(multiplicity)')} AS multiplicity, version FROM event_signed GROUP BY key, version HAVING sum(multiplicity) <> 0", "event_signed"))
def _(spark, d):
    return C.consolidate(J.event_signed(spark, d).drop("value"))


@query("l7_sorted", sql(_CONSOLIDATED + " ORDER BY key, value", "event_signed"))
def _(spark, d):
    return C.in_order(J.event_signed(spark, d).drop("version"))


@query("l8_difference", sql(
    f"SELECT key, value, {_big('sum(m)')} AS multiplicity FROM (SELECT key, value, multiplicity AS m FROM event_log UNION ALL SELECT key, value, -multiplicity FROM event_signed) GROUP BY key, value HAVING sum(m) <> 0", "event_log", "event_signed"))
def _(spark, d):
    return C.difference(J.event_log(spark, d).drop("version"), J.event_signed(spark, d).drop("version"))


# ---- joins -------------------------------------------------------------------------------------

@query("j1_join", sql(
    "SELECT o.key, o.value, l.value AS value_right, o.multiplicity * l.m AS multiplicity FROM order_trace o JOIN (SELECT key, value, CAST(sum(multiplicity) AS BIGINT) AS m FROM line_trace GROUP BY key, value) l ON o.key IS NOT DISTINCT FROM l.key", "order_trace", "line_trace"))
def _(spark, d):
    return C.join(J.order_trace(spark, d).drop("version"), C.consolidate(J.line_trace(spark, d).drop("version")), ["key"])


_JOINED = "SELECT o.key, o.value, l.value AS value_right, greatest(o.version, l.version) AS version, o.multiplicity * l.multiplicity AS multiplicity FROM order_trace o JOIN line_trace l ON o.key = l.key"


@query("j2_join_trace", sql(_JOINED, "order_trace", "line_trace"))
def _(spark, d):
    return T.join_trace(J.order_trace(spark, d), J.line_trace(spark, d), ["key"])


_PRODUCT_B = f"b AS (SELECT c_custkey AS key, c_nationkey AS nation, {ONE} AS multiplicity, c_nationkey % 7 AS v0, c_nationkey % 5 + 1 AS v1 FROM customer)"


def _customers(spark, d) -> DataFrame:
    c = J.read(spark, d, "customer")
    return S.collection(c.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), (F.col("c_nationkey") % 7).alias("v0"), (F.col("c_nationkey") % 5 + 1).alias("v1")))


@query("j3_join_product", sql(
    "SELECT a.key, a.value, b.nation, greatest(a.v0, b.v0) AS v0, greatest(a.v1, b.v1) AS v1, a.multiplicity * b.multiplicity AS multiplicity FROM order_churn2 a JOIN b ON a.key = b.key", "order_churn2", more=_PRODUCT_B))
def _(spark, d):
    return T.join_trace(J.order_churn2(spark, d), _customers(spark, d), ["key"], versions=["v0", "v1"])


@query("j4_semijoin", sql(
    f"SELECT o.key, o.value, o.multiplicity * k.m AS multiplicity FROM order_trace o JOIN (SELECT key, {_big('count(*)')} AS m FROM line_trace WHERE value = 1 GROUP BY key) k ON o.key = k.key", "order_trace", "line_trace"))
def _(spark, d):
    keys = C.consolidate(J.line_trace(spark, d).where("value = 1").select("key", M))
    return C.semijoin(J.order_trace(spark, d).drop("version"), keys, ["key"])


# ---- aggregates on one collection --------------------------------------------------------------

def _two_least(rows):
    return [(v, 1) for v, m in rows if m > 0][:2]


@query("a1_reduce", sql(
    f"SELECT key, value, {ONE} AS multiplicity FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value) AS r FROM order_churn GROUP BY key, value HAVING sum(multiplicity) > 0) WHERE r <= 2", "order_churn"))
def _(spark, d):
    return C.reduce_groups(J.order_churn(spark, d).drop("version"), ["key"], ["value"], _two_least, "value bigint")


@query("a2_count", sql(f"SELECT key, {_big('sum(multiplicity)')} AS count, {ONE} AS multiplicity FROM order_churn GROUP BY key", "order_churn"))
def _(spark, d):
    return C.count(J.order_churn(spark, d), ["key"])


@query("a3_sum", sql(f"SELECT key, {_big('sum(value * multiplicity)')} AS sum, {ONE} AS multiplicity FROM order_churn GROUP BY key", "order_churn"))
def _(spark, d):
    return C.sum_values(J.order_churn(spark, d), ["key"], "value")


_PRESENT = "(SELECT key, value FROM order_churn GROUP BY key, value HAVING sum(multiplicity) > 0)"


@query("a4_min", sql(f"SELECT key, min(value) AS min, {ONE} AS multiplicity FROM {_PRESENT} GROUP BY key", "order_churn"))
def _(spark, d):
    return C.min_value(J.order_churn(spark, d), ["key"], "value")


@query("a5_max", sql(f"SELECT key, max(value) AS max, {ONE} AS multiplicity FROM {_PRESENT} GROUP BY key", "order_churn"))
def _(spark, d):
    return C.max_value(J.order_churn(spark, d), ["key"], "value")


@query("a6_distinct", sql(f"SELECT key, value, {ONE} AS multiplicity FROM {_PRESENT}", "order_churn"))
def _(spark, d):
    return C.distinct(J.order_churn(spark, d), ["key", "value"])


# ---- aggregates on traces ----------------------------------------------------------------------

def _changes_sql(term: str, name: str, source: str, order: str = "version") -> str:
    """Running sum by key, and a -1/+1 pair where it differs from the one before."""
    return (f"SELECT key, {name}, m AS multiplicity, {order} FROM (SELECT key, {order}, unnest([old, {name}]) AS {name}, unnest([CAST(-1 AS BIGINT), CAST(1 AS BIGINT)]) AS m FROM "
            f"(SELECT *, lag({name}) OVER (PARTITION BY key ORDER BY {order}) AS old FROM (SELECT key, {order}, {_big('sum(d) OVER (PARTITION BY key ORDER BY ' + order + ')')} AS {name} "
            f"FROM (SELECT key, {order}, sum({term}) AS d FROM {source} GROUP BY key, {order}))) WHERE old IS NULL OR old <> {name}) WHERE {name} IS NOT NULL")


@query("r1_count_trace", sql(_changes_sql("multiplicity", "count", "order_churn"), "order_churn"))
def _(spark, d):
    return T.count_trace(J.order_churn(spark, d), ["key"])


@query("r2_sum_trace", sql(_changes_sql("value * multiplicity", "sum", "order_churn"), "order_churn"))
def _(spark, d):
    return T.sum_trace(J.order_churn(spark, d), ["key"], "value")


_INTERVALS = ("spans AS (SELECT key, value, version AS f, coalesce(lead(version) OVER w, 1000000) AS t, sum(d) OVER w AS net FROM "
              "(SELECT key, value, version, sum(multiplicity) AS d FROM order_churn GROUP BY key, value, version HAVING sum(multiplicity) <> 0) WINDOW w AS (PARTITION BY key, value ORDER BY version))")


def _extreme_sql(name: str) -> str:
    """Validity intervals meet the key's change versions; then differences along versions."""
    best = f"best AS (SELECT v.key, v.version, {name}(s.value) AS x FROM (SELECT DISTINCT key, version FROM order_churn) v LEFT JOIN spans s ON s.key = v.key AND s.net > 0 AND s.f <= v.version AND v.version < s.t GROUP BY v.key, v.version)"
    body = (f"SELECT key, {name}, m AS multiplicity, version FROM (SELECT key, version, unnest([old, x]) AS {name}, unnest([CAST(-1 AS BIGINT), CAST(1 AS BIGINT)]) AS m FROM "
            f"(SELECT *, lag(x) OVER (PARTITION BY key ORDER BY version) AS old FROM best) WHERE x IS DISTINCT FROM old) WHERE {name} IS NOT NULL")
    return sql(body, "order_churn", more=f"{_INTERVALS}, {best}")


@query("r3_min_trace", _extreme_sql("min"))
def _(spark, d):
    return T.min_trace(J.order_churn(spark, d), ["key"], "value")


@query("r4_max_trace", _extreme_sql("max"))
def _(spark, d):
    return T.max_trace(J.order_churn(spark, d), ["key"], "value")


# One key with a third of all rows.
_HOT = "hot AS (SELECT CASE WHEN key % 3 = 0 THEN 0 ELSE key END AS key, value, multiplicity, version FROM order_churn)"


def _hot_trace(spark, d) -> DataFrame:
    return J.order_churn(spark, d).withColumn("key", F.when(F.col("key") % 3 == 0, 0).otherwise(F.col("key")))


def _hot_sql(name: str) -> str:
    return _extreme_sql(name).replace("order_churn)", "hot)").replace("FROM order_churn GROUP", "FROM hot GROUP").replace(", spans AS", f", {_HOT}, spans AS", 1)


@query("r3_min_hot", _hot_sql("min"))
def _(spark, d):
    return T.min_trace(_hot_trace(spark, d), ["key"], "value", spread=16)


@query("r4_max_hot", _hot_sql("max"))
def _(spark, d):
    return T.max_trace(_hot_trace(spark, d), ["key"], "value", spread=16)


_DISTINCT = ("SELECT key, value, p - old AS multiplicity, version FROM (SELECT key, value, version, p, lag(p, 1, CAST(0 AS BIGINT)) OVER (PARTITION BY key, value ORDER BY version) AS old FROM "
             "(SELECT key, value, version, CAST(CASE WHEN sum(d) OVER (PARTITION BY key, value ORDER BY version) > 0 THEN 1 ELSE 0 END AS BIGINT) AS p FROM "
             "(SELECT key, value, version, sum(multiplicity) AS d FROM {0} GROUP BY key, value, version))) WHERE p <> old")


@query("r5_distinct_trace", sql(_DISTINCT.format("order_churn"), "order_churn"))
def _(spark, d):
    return T.distinct_trace(J.order_churn(spark, d), ["key", "value"])


def _largest_only(rows):
    live = [v for v, m in rows if m > 0]
    return [(live[-1], 1)] if live else []


@query("r6_reduce_trace", _extreme_sql("max"))
def _(spark, d):
    return T.reduce_trace(J.order_churn(spark, d), ["key"], ["value"], _largest_only, "max bigint")


def _product_sql(own: str, name: str, answer: str, source: str) -> str:
    """Snapshots on each key's grid by definition, then inclusion and exclusion along both axes."""
    keys = f"key{own}"
    same = " AND ".join(f"s.{k} = g.{k}" for k in keys.split(", "))
    grid = f"grid AS (SELECT * FROM (SELECT DISTINCT {keys}, v0 FROM {source}) JOIN (SELECT DISTINCT {keys}, v1 FROM {source}) USING ({keys}))"
    snap = f"snap AS (SELECT {', '.join('g.' + k for k in keys.split(', '))}, g.v0, g.v1, {answer} AS x FROM grid g LEFT JOIN {source} s ON {same} AND s.v0 <= g.v0 AND s.v1 <= g.v1 GROUP BY ALL)"
    lags = (f"l1 AS (SELECT *, lag(x) OVER (PARTITION BY {keys}, v1 ORDER BY v0) AS a, lag(x) OVER (PARTITION BY {keys}, v0 ORDER BY v1) AS b FROM snap), "
            f"l2 AS (SELECT *, lag(a) OVER (PARTITION BY {keys}, v0 ORDER BY v1) AS c FROM l1)")
    return f"{grid}, {snap}, {lags}"


_FOUR = "SELECT key, v0, v1, unnest([x, a, b, c]) AS {0}, unnest([1, -1, -1, 1]) AS m FROM l2"


@query("r7_count_product", sql(
    f"SELECT key, count, {_big('sum(m)')} AS multiplicity, v0, v1 FROM ({_FOUR.format('count')}) WHERE count IS NOT NULL GROUP BY key, count, v0, v1 HAVING sum(m) <> 0",
    "order_churn2", more=_product_sql("", "count", "CAST(sum(s.multiplicity) AS BIGINT)", "order_churn2")))
def _(spark, d):
    return T.count_product(J.order_churn2(spark, d), ["key"])


@query("r7_min_product", sql(
    f"SELECT key, min, {_big('sum(m)')} AS multiplicity, v0, v1 FROM ({_FOUR.format('min')}) WHERE min IS NOT NULL GROUP BY key, min, v0, v1 HAVING sum(m) <> 0",
    "order_churn2", more=_product_sql("", "min", "min(s.value)", "order_churn2")))
def _(spark, d):
    return T.min_product(J.order_churn2(spark, d), ["key"], "value")


@query("r7_distinct_product", sql(
    f"SELECT key, value, {_big('x - coalesce(a, 0) - coalesce(b, 0) + coalesce(c, 0)')} AS multiplicity, v0, v1 FROM l2 WHERE x - coalesce(a, 0) - coalesce(b, 0) + coalesce(c, 0) <> 0",
    "order_churn2", more="t AS (SELECT key, value // 5000000 AS value, multiplicity, v0, v1 FROM order_churn2), " + _product_sql(", value", "x", "CASE WHEN coalesce(sum(s.multiplicity), 0) > 0 THEN 1 ELSE 0 END", "t")))
def _(spark, d):
    return T.distinct_product(J.order_churn2(spark, d).withColumn("value", F.expr("value div 5000000")), ["key", "value"])


@query("r8_count_lex", sql(
    "SELECT key, count, multiplicity, version.v0 AS v0, version.v1 AS v1 FROM (" + _changes_sql("multiplicity", "count", "t") + ")",
    "order_churn2", more="t AS (SELECT key, value, multiplicity, {'v0': v0, 'v1': v1} AS version FROM order_churn2)"))
def _(spark, d):
    tr = J.order_churn2(spark, d).withColumn("version", V.lexicographic(["v0", "v1"])).drop("v0", "v1")
    return T.count_trace(tr, ["key"]).select("key", "count", M, "version.v0", "version.v1")


_SUMMED = "SELECT key, {0}, CAST(sum(m) AS BIGINT) AS multiplicity, v0, v1 FROM ({1}) WHERE {0} IS NOT NULL GROUP BY key, {0}, v0, v1 HAVING sum(m) <> 0"


@query("r7_sum_product", sql(_SUMMED.format("sum", _FOUR.format("sum")), "order_churn2", more=_product_sql("", "sum", "CAST(sum(s.value * s.multiplicity) AS BIGINT)", "order_churn2")))
def _(spark, d):
    return T.sum_product(J.order_churn2(spark, d), ["key"], "value")


_MAX_PRODUCT = sql(_SUMMED.format("max", _FOUR.format("max")), "order_churn2", more=_product_sql("", "max", "max(s.value)", "order_churn2"))


@query("r7_max_product", _MAX_PRODUCT)
def _(spark, d):
    return T.max_product(J.order_churn2(spark, d), ["key"], "value")


@query("r7_reduce_product", _MAX_PRODUCT)
def _(spark, d):
    return T.reduce_product(J.order_churn2(spark, d), ["key"], ["value"], _largest_only, "max bigint")


# Lexicographic versions, taken back six digits later by some orders.
_LEX = ("t AS (SELECT key, value, multiplicity, {'v0': v0, 'v1': v1} AS version FROM order_churn2 UNION ALL "
        "SELECT key, value, -multiplicity, {'v0': v0 + 1, 'v1': v1} FROM order_churn2 WHERE value % 3 = 0)")


def _lex_trace(spark, d) -> DataFrame:
    tr = J.order_churn2(spark, d)
    both = tr.unionByName(C.negate(tr.where("value % 3 = 0")).withColumn("v0", F.col("v0") + 1))
    return both.withColumn("version", V.lexicographic(["v0", "v1"])).drop("v0", "v1")


def _parted(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "version"], "version.v0", "version.v1")


_LEX_OUT = "SELECT {0}, multiplicity, version.v0 AS v0, version.v1 AS v1 FROM ({1})"


def _odd_extreme(name: str, source: str) -> str:
    """As ``_extreme_sql`` for any order of versions; null keys are a key, null values no candidates."""
    spans = (f"spans AS (SELECT key, value, version AS f, lead(version) OVER w AS t, sum(d) OVER w AS net FROM (SELECT key, value, version, sum(multiplicity) AS d "
             f"FROM {source} WHERE value IS NOT NULL GROUP BY key, value, version HAVING sum(multiplicity) <> 0) WINDOW w AS (PARTITION BY key, value ORDER BY version))")
    best = (f"best AS (SELECT v.key, v.version, {name}(s.value) AS x FROM (SELECT DISTINCT key, version FROM {source}) v LEFT JOIN spans s ON s.key IS NOT DISTINCT FROM v.key "
            f"AND s.net > 0 AND s.f <= v.version AND (s.t IS NULL OR v.version < s.t) GROUP BY v.key, v.version)")
    return f"{spans}, {best}"


def _odd_changes(name: str) -> str:
    return (f"SELECT key, {name}, m AS multiplicity, version FROM (SELECT key, version, unnest([old, x]) AS {name}, unnest([CAST(-1 AS BIGINT), CAST(1 AS BIGINT)]) AS m FROM "
            f"(SELECT *, lag(x) OVER (PARTITION BY key ORDER BY version) AS old FROM best) WHERE x IS DISTINCT FROM old) WHERE {name} IS NOT NULL")


@query("r8_sum_lex", sql(_LEX_OUT.format("key, sum", _changes_sql("value * multiplicity", "sum", "t")), "order_churn2", more=_LEX))
def _(spark, d):
    return _parted(T.sum_trace(_lex_trace(spark, d), ["key"], "value"))


@query("r8_distinct_lex", sql(_LEX_OUT.format("key, value", _DISTINCT.format("t")), "order_churn2", more=_LEX))
def _(spark, d):
    return _parted(T.distinct_trace(_lex_trace(spark, d), ["key", "value"]))


for _name, _f in (("min", lambda tr: T.min_trace(tr, ["key"], "value")), ("max", lambda tr: T.max_trace(tr, ["key"], "value")),
                  ("reduce", lambda tr: T.reduce_trace(tr, ["key"], ["value"], _largest_only, "max bigint"))):
    _of = "min" if _name == "min" else "max"
    query(f"r8_{_name}_lex", sql(_LEX_OUT.format(f"key, {_of}", _odd_changes(_of)), "order_churn2", more=f"{_LEX}, {_odd_extreme(_of, 't')}"))(
        lambda spark, d, f=_f: _parted(f(_lex_trace(spark, d))))


# Null keys, null values, and integers beyond 2 ** 53.
_ODD = ("odd AS (SELECT CASE WHEN key % 10 = 0 THEN NULL ELSE key + 9007199254740992 END AS key, CASE WHEN value % 7 = 0 THEN NULL ELSE value + 9007199254740992 END AS value, multiplicity, version FROM order_churn)")


def _as_text(value: str, body: str, more: str = "") -> str:
    """Keys and values as text, as some clients turn integers beside nulls to floats."""
    return f"SELECT CAST(key AS VARCHAR) AS key, CAST({value} AS VARCHAR) AS {value}, multiplicity{more} FROM ({body})"


def _texts(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in df.columns if c not in (M, "version")})


def _odd_trace(spark, d) -> DataFrame:
    big = F.lit(9007199254740992).cast("bigint")
    return J.order_churn(spark, d).select(F.when(F.col("key") % 10 != 0, F.col("key") + big).alias("key"), F.when(F.col("value") % 7 != 0, F.col("value") + big).alias("value"), M, "version")


@query("r3_min_odd", sql(_as_text("min", _odd_changes("min"), ", version"), "order_churn", more=f"{_ODD}, {_odd_extreme('min', 'odd')}"))
def _(spark, d):
    return _texts(T.min_trace(_odd_trace(spark, d), ["key"], "value"))


@query("r4_max_odd", sql(_as_text("max", _odd_changes("max"), ", version"), "order_churn", more=f"{_ODD}, {_odd_extreme('max', 'odd')}"))
def _(spark, d):
    return _texts(T.max_trace(_odd_trace(spark, d), ["key"], "value"))


@query("r6_reduce_odd", sql(_as_text("max", _odd_changes("max"), ", version"), "order_churn", more=f"{_ODD}, {_odd_extreme('max', 'odd')}"))
def _(spark, d):
    largest = lambda rows: [(v, 1) for v, m in rows if m > 0 and v[0] is not None][-1:]
    return _texts(T.reduce_trace(_odd_trace(spark, d), ["key"], ["value"], largest, "max bigint"))


@query("a1_reduce_odd", sql(
    _as_text("value", f"SELECT key, value, {ONE} AS multiplicity FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value NULLS FIRST) AS r FROM odd GROUP BY key, value HAVING sum(multiplicity) > 0) WHERE r <= 2"), "order_churn", more=_ODD))
def _(spark, d):
    return _texts(C.reduce_groups(_odd_trace(spark, d).drop("version"), ["key"], ["value"], _two_least, "value bigint"))


# ---- versions as data --------------------------------------------------------------------------

@query("v1_snapshot", sql(f"SELECT key, value, {_big('sum(multiplicity)')} AS multiplicity FROM order_churn WHERE version <= 20 GROUP BY key, value HAVING sum(multiplicity) <> 0", "order_churn"))
def _(spark, d):
    return T.snapshot_at(J.order_churn(spark, d), {"version": 20})


@query("v2_snapshots", sql(f"SELECT key, value, {_big('net')} AS multiplicity, f AS valid_from, CASE WHEN t < 1000000 THEN t END AS valid_to FROM spans WHERE net <> 0", "order_churn", more=_INTERVALS))
def _(spark, d):
    return T.snapshots(J.order_churn(spark, d))


@query("v3_delta", sql(
    f"SELECT key, value, {_big('sum(multiplicity)')} AS multiplicity FROM order_churn WHERE version > 20 AND version <= 30 GROUP BY key, value HAVING sum(multiplicity) <> 0", "order_churn"))
def _(spark, d):
    tr = J.order_churn(spark, d)
    return T.delta_between(T.snapshot_at(tr, {"version": 20}), T.snapshot_at(tr, {"version": 30}))


@query("v4_versions", sql("SELECT DISTINCT key, version FROM order_churn", "order_churn"))
def _(spark, d):
    return T.versions_of(J.order_churn(spark, d), ["key"])


@query("v5_compact", sql(
    f"SELECT key, value, {_big('sum(multiplicity)')} AS multiplicity, v FROM (SELECT key, value, multiplicity, greatest(version, 24) AS v FROM order_churn) GROUP BY key, value, v HAVING sum(multiplicity) <> 0".replace(", v FROM (", ", v AS version FROM ("), "order_churn"))
def _(spark, d):
    return T.compact(J.order_churn(spark, d), [(24,)])


@query("v6_append", sql("SELECT key, value, multiplicity, version FROM order_trace UNION ALL SELECT key, CAST(value AS BIGINT), multiplicity, version FROM line_trace", "order_trace", "line_trace"))
def _(spark, d):
    return T.append_trace(J.order_trace(spark, d), J.line_trace(spark, d).withColumn("value", F.col("value").cast("bigint")))


@query("v7_leq", sql("SELECT key, value, v0, v1, (v0 <= 3 AND v1 <= 2) AS leq, (v0 <= 3 AND v1 <= 2 AND NOT (v0 = 3 AND v1 = 2)) AS lt FROM order_churn2", "order_churn2"))
def _(spark, d):
    return J.order_churn2(spark, d).select("key", "value", "v0", "v1", V.version_leq(["v0", "v1"], [3, 2]).alias("leq"), V.version_lt(["v0", "v1"], [3, 2]).alias("lt"))


@query("v8_lub_glb", sql("SELECT key, value, greatest(v0, 3) AS lub0, greatest(v1, 2) AS lub1, least(v0, 3) AS glb0, least(v1, 2) AS glb1 FROM order_churn2", "order_churn2"))
def _(spark, d):
    up, down = V.version_lub(["v0", "v1"], [3, 2]), V.version_glb(["v0", "v1"], [3, 2])
    return J.order_churn2(spark, d).select("key", "value", *[x.alias(n) for x, n in zip([*up, *down], ["lub0", "lub1", "glb0", "glb1"])])


@query("v9_advance", sql("SELECT key, value, least(greatest(v0, 2), greatest(v0, 1)) AS v0, least(greatest(v1, 1), greatest(v1, 3)) AS v1 FROM order_churn2", "order_churn2"))
def _(spark, d):
    return J.order_churn2(spark, d).select("key", "value", *[x.alias(n) for x, n in zip(V.advance_by(["v0", "v1"], [(2, 1), (1, 3)]), ["v0", "v1"])])


@query("v10_lex", sql("SELECT key, min(v0 * 100 + v1) // 100 AS v0, min(v0 * 100 + v1) % 100 AS v1 FROM order_churn2 GROUP BY key", "order_churn2"))
def _(spark, d):
    first = J.order_churn2(spark, d).groupBy("key").agg(F.min(V.lexicographic(["v0", "v1"])).alias("v"))
    return first.select("key", "v.v0", "v.v1")


_MINIMAL = "SELECT DISTINCT v0, v1 FROM {0} a WHERE NOT EXISTS (SELECT 1 FROM {0} b WHERE b.v0 <= a.v0 AND b.v1 <= a.v1 AND (b.v0 < a.v0 OR b.v1 < a.v1))"
_HALVES = "f AS (SELECT v0, 6 - v1 AS v1 FROM order_churn2 WHERE v0 >= 3 AND v1 <= 3 AND key % 2 = 0), g AS (SELECT v0, v1 FROM order_churn2 WHERE v0 + v1 > 3 AND key % 2 = 1)"


def _halves(spark, d):
    tr = J.order_churn2(spark, d)
    f = tr.where("v0 >= 3 and v1 <= 3 and key % 2 = 0").select("v0", (6 - F.col("v1")).alias("v1"))
    return f, tr.where("v0 + v1 > 3 and key % 2 = 1").select("v0", "v1")


@query("v11_minimal", sql(_MINIMAL.format("g"), "order_churn2", more=_HALVES))
def _(spark, d):
    return V.minimal_versions(_halves(spark, d)[1], ["v0", "v1"])


@query("v12_meet", sql(_MINIMAL.format("u"), "order_churn2", more=_HALVES + ", u AS (SELECT * FROM f UNION ALL SELECT * FROM g)"))
def _(spark, d):
    return V.frontier_meet(*_halves(spark, d), ["v0", "v1"])


@query("v13_frontier_leq", sql("SELECT DISTINCT v0, v1 FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.v0 <= g.v0 AND f.v1 <= g.v1)", "order_churn2", more=_HALVES))
def _(spark, d):
    f, g = _halves(spark, d)
    return V.not_covered(V.minimal_versions(f, ["v0", "v1"]), g.distinct(), ["v0", "v1"])


# Whole tables: every order and line item, versions (day, digit).
_DAYS = ("f AS (SELECT DISTINCT datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS v0, 8 - l_linenumber AS v1 FROM lineitem), "
         "g AS (SELECT DISTINCT datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS v0, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS v1 FROM orders)")


def _days(spark, d):
    day = lambda c: F.datediff(F.col(c), F.lit("1992-01-01").cast("date")).alias("v0")
    f = J.read(spark, d, "lineitem").select(day("l_shipdate"), (8 - F.col("l_linenumber")).cast("int").alias("v1"))
    return f.distinct(), J.read(spark, d, "orders").select(day("o_orderdate"), F.substring("o_orderpriority", 1, 1).cast("int").alias("v1")).distinct()


@query("v11_minimal_whole", sql(_MINIMAL.format("order_churn2"), "order_churn2"))
def _(spark, d):
    return V.minimal_versions(J.order_churn2(spark, d).select("v0", "v1"), ["v0", "v1"])


@query("v12_meet_whole", sql(_MINIMAL.format("u"), more=_DAYS + ", u AS (SELECT * FROM f UNION SELECT * FROM g)"))
def _(spark, d):
    return V.frontier_meet(*_days(spark, d), ["v0", "v1"])


@query("v13_frontier_leq_whole", sql("SELECT DISTINCT v0, v1 FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.v0 <= g.v0 AND f.v1 <= g.v1)", more=_DAYS))
def _(spark, d):
    f, g = _days(spark, d)
    return V.not_covered(V.minimal_versions(f, ["v0", "v1"]), g, ["v0", "v1"])


# Versions that trade one coordinate for another, so that hundreds are minimal.
_TRADES = ("g AS (SELECT DISTINCT datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS v0, CAST(6000 - 2 * datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + o_custkey % 40 AS BIGINT) AS v1, CAST(o_orderkey % 30 AS BIGINT) AS v2 FROM orders), "
           "f AS (SELECT DISTINCT datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS v0, CAST(6000 - 2 * datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + l_partkey % 80 AS BIGINT) AS v1, CAST(l_orderkey % 30 + l_linenumber AS BIGINT) AS v2 FROM lineitem)")
_BELOW3 = "{0}.v0 <= {1}.v0 AND {0}.v1 <= {1}.v1 AND {0}.v2 <= {1}.v2"
_MINIMAL3 = "SELECT v0, v1, v2 FROM {0} a WHERE NOT EXISTS (SELECT 1 FROM {0} b WHERE " + _BELOW3.format("b", "a") + " AND (b.v0 < a.v0 OR b.v1 < a.v1 OR b.v2 < a.v2))"


def _trades(spark, d) -> tuple[DataFrame, DataFrame]:
    def of(df, day, key, low):
        day = F.datediff(F.col(day), F.lit("1992-01-01").cast("date"))
        return df.select(day.alias("v0"), (6000 - 2 * day + key).cast("bigint").alias("v1"), low.cast("bigint").alias("v2")).distinct()
    f = of(J.read(spark, d, "lineitem"), "l_shipdate", F.col("l_partkey") % 80, F.col("l_orderkey") % 30 + F.col("l_linenumber"))
    return f, of(J.read(spark, d, "orders"), "o_orderdate", F.col("o_custkey") % 40, F.col("o_orderkey") % 30)


@query("v11_minimal_trade", sql("SELECT DISTINCT v0, v1 FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.v0 <= a.v0 AND b.v1 <= a.v1 AND (b.v0 < a.v0 OR b.v1 < a.v1))", more=_TRADES))
def _(spark, d):
    return V.minimal_versions(_trades(spark, d)[1], ["v0", "v1"])


@query("v11_minimal_three", sql(_MINIMAL3.format("g"), more=_TRADES))
def _(spark, d):
    return V.minimal_versions(_trades(spark, d)[1], _XYZ)


@query("v12_meet_three", sql(_MINIMAL3.format("u"), more=_TRADES + ", u AS (SELECT * FROM f UNION SELECT * FROM g)"))
def _(spark, d):
    return V.frontier_meet(*_trades(spark, d), _XYZ)


@query("v13_frontier_trade", sql("SELECT v0, v1, v2 FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE " + _BELOW3.format("f", "g") + ")", more=_TRADES))
def _(spark, d):
    f, g = _trades(spark, d)
    return V.not_covered(f, g, _XYZ)


@query("v13_frontier_two", sql("SELECT v0, v1 FROM (SELECT DISTINCT v0, v1 FROM g) g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.v0 <= g.v0 AND f.v1 <= g.v1)", more=_TRADES))
def _(spark, d):
    f, g = _trades(spark, d)
    return V.not_covered(f, g.select("v0", "v1").distinct(), ["v0", "v1"])


@query("v14_split", sql("SELECT key, value, v0, v1, NOT ((2 <= v0 AND 1 <= v1) OR (1 <= v0 AND 3 <= v1)) AS closed FROM order_churn2", "order_churn2"))
def _(spark, d):
    closed, opened = V.split_by_frontier(J.order_churn2(spark, d).drop(M), ["v0", "v1"], [(2, 1), (1, 3)])
    return closed.withColumn("closed", F.lit(True)).unionByName(opened.withColumn("closed", F.lit(False)))


# ---- iteration ---------------------------------------------------------------------------------

_SEEDS = f"SELECT DISTINCT o_custkey % 50 + 1 AS x, {ONE} AS multiplicity FROM orders"


def _seeds(spark, d) -> DataFrame:
    return S.collection(J.read(spark, d, "orders").select((F.col("o_custkey") % 50 + 1).alias("x")).distinct())


_DOUBLED = f"c AS (SELECT x FROM ({_SEEDS}) UNION SELECT x * 2 FROM c WHERE x * 2 <= 5000)"


@query("i1_iterate", sql(f"SELECT x, {ONE} AS multiplicity FROM c", more=_DOUBLED, recursive=True))
def _(spark, d):
    return I.iterate(_seeds(spark, d), J.closure_step(5000, lambda x: x * 2))


@query("i4_semi_naive", sql(f"SELECT x, {ONE} AS multiplicity FROM c", more=_DOUBLED, recursive=True))
def _(spark, d):
    return I.iterate_insert_only(_seeds(spark, d), lambda df: df.withColumn("x", F.col("x") * 2).where("x <= 5000"))


_THREE = "c AS (SELECT x, 0 AS r FROM ({0}) UNION SELECT x * 2, r + 1 FROM c WHERE x * 2 <= 5000 AND r < 3)".format(_SEEDS)


@query("i3_bounded", sql(f"SELECT DISTINCT x, {ONE} AS multiplicity FROM c", more=_THREE, recursive=True))
def _(spark, d):
    return I.iterate(_seeds(spark, d), J.closure_step(5000, lambda x: x * 2), max_rounds=3, on_limit="return")


@query("i5_round_log", sql(f"SELECT x, {ONE} AS multiplicity, CAST(min(r) AS INTEGER) AS round FROM c GROUP BY x",
                           more="c AS (SELECT x, 0 AS r FROM ({0}) UNION SELECT x * 2, r + 1 FROM c WHERE x * 2 <= 5000)".format(_SEEDS), recursive=True))
def _(spark, d):
    return I.iterate_log(_seeds(spark, d), J.closure_step(5000, lambda x: x * 2))


_CLOSURE_TRACE = f"SELECT key % 60 + 1 AS x, multiplicity, version // 12 AS version FROM order_churn"
_CLOSURES = ("tr AS (" + _CLOSURE_TRACE + "), vs AS (SELECT DISTINCT version FROM tr), "
             "inp AS (SELECT vs.version, x FROM vs JOIN tr ON tr.version <= vs.version GROUP BY vs.version, x HAVING sum(multiplicity) > 0), "
             "c AS (SELECT version, x FROM inp UNION SELECT version, x * 2 FROM c WHERE x * 2 <= 500), "
             "n AS (SELECT version, lead(version) OVER (ORDER BY version) AS nxt FROM vs), "
             "d AS (SELECT x, 1 AS m, version FROM c UNION ALL SELECT x, -1, nxt FROM c JOIN n USING (version) WHERE nxt IS NOT NULL)")
_CLOSURE_SQL = sql(f"SELECT x, {_big('sum(m)')} AS multiplicity, version FROM d GROUP BY x, version HAVING sum(m) <> 0", "order_churn", more=_CLOSURES, recursive=True)


def _closure_trace(spark, d) -> DataFrame:
    return J.order_churn(spark, d).select((F.col("key") % 60 + 1).alias("x"), M, F.expr("cast(version div 12 as int)").alias("version"))


@query("i2_iterate_trace", _CLOSURE_SQL)
def _(spark, d):
    return I.iterate_trace(_closure_trace(spark, d), J.closure_step(500, lambda x: x * 2))


@query("x3_closure", _CLOSURE_SQL.replace("x * 2", "x * 3"))
def _(spark, d):
    return I.iterate_trace(_closure_trace(spark, d), J.closure_step(500, lambda x: x * 3))


# Whole tables: every key, closed up to the largest key.
_ALL_SEEDS = "s AS (SELECT DISTINCT o_custkey AS x FROM orders WHERE o_custkey IS NOT NULL), top AS (SELECT max(x) AS t FROM s)"
_ALL_CLOSED = _ALL_SEEDS + ", c AS (SELECT x FROM s UNION SELECT {0} FROM c, top WHERE {0} <= t)"
_ALL_ROUNDS = _ALL_SEEDS + ", c AS (SELECT x, 0 AS r FROM s UNION SELECT x * 2, r + 1 FROM c, top WHERE x * 2 <= t{0})"


def _all_seeds(spark, d) -> tuple[DataFrame, int]:
    """Every customer key of the orders, and the largest."""
    seeds = S.collection(J.read(spark, d, "orders").select(F.col("o_custkey").cast("bigint").alias("x")).where("x is not null").distinct())
    return seeds, _top(seeds)


def _top(df: DataFrame) -> int:
    return df.agg(F.max("x")).first()[0] or 0


@query("i1_iterate_whole", sql(f"SELECT x, {ONE} AS multiplicity FROM c", more=_ALL_CLOSED.format("x * 2"), recursive=True))
def _(spark, d):
    seeds, top = _all_seeds(spark, d)
    return I.iterate(seeds, J.closure_step(top, lambda x: x * 2))


@query("i4_semi_naive_whole", sql(f"SELECT x, {ONE} AS multiplicity FROM c", more=_ALL_CLOSED.format("x * 2"), recursive=True))
def _(spark, d):
    seeds, top = _all_seeds(spark, d)
    return I.iterate_insert_only(seeds, lambda df: df.withColumn("x", F.col("x") * 2).where(F.col("x") <= top))


@query("i3_bounded_whole", sql(f"SELECT DISTINCT x, {ONE} AS multiplicity FROM c", more=_ALL_ROUNDS.format(" AND r < 3"), recursive=True))
def _(spark, d):
    seeds, top = _all_seeds(spark, d)
    return I.iterate(seeds, J.closure_step(top, lambda x: x * 2), max_rounds=3, on_limit="return")


@query("i5_round_log_whole", sql(f"SELECT x, {ONE} AS multiplicity, CAST(min(r) AS INTEGER) AS round FROM c GROUP BY x", more=_ALL_ROUNDS.format(" AND x > 0"), recursive=True))
def _(spark, d):
    seeds, top = _all_seeds(spark, d)
    return I.iterate_log(seeds, J.closure_step(top, lambda x: x * 2))


# Every customer key by year, orders taken back six months later: the closure at each version.
_ALL_TRACE = ("tr AS (SELECT key AS x, multiplicity, CAST(version // 12 AS INTEGER) AS version FROM order_churn WHERE key IS NOT NULL), top AS (SELECT max(x) AS t FROM tr), vs AS (SELECT DISTINCT version FROM tr), "
              "inp AS (SELECT vs.version, x FROM vs JOIN tr ON tr.version <= vs.version GROUP BY vs.version, x HAVING sum(multiplicity) > 0), ")
_ALL_CLOSURES = (_ALL_TRACE + "c AS (SELECT version, x FROM inp UNION SELECT version, {0} FROM c, top WHERE {0} <= t), n AS (SELECT version, lead(version) OVER (ORDER BY version) AS nxt FROM vs), "
                 "d AS (SELECT x, 1 AS m, version FROM c UNION ALL SELECT x, -1, nxt FROM c JOIN n USING (version) WHERE nxt IS NOT NULL)")


def _all_closures(by: str) -> str:
    return sql(f"SELECT x, {_big('sum(m)')} AS multiplicity, version FROM d GROUP BY x, version HAVING sum(m) <> 0", "order_churn", more=_ALL_CLOSURES.format(by), recursive=True)


def _all_trace(spark, d) -> tuple[DataFrame, int]:
    tr = J.order_churn(spark, d).where("key is not null").select(F.col("key").cast("bigint").alias("x"), M, F.expr("cast(version div 12 as int)").alias("version"))
    return tr, _top(tr)


@query("i2_iterate_trace_whole", _all_closures("x * 2"))
def _(spark, d):
    tr, top = _all_trace(spark, d)
    return N.iterate_changes(tr, J.reached(top, lambda x: x * 2), ["x"])


@query("x3_closure_whole", _all_closures("x * 3"))
def _(spark, d):
    tr, top = _all_trace(spark, d)
    return N.iterate_changes(tr, J.reached(top, lambda x: x * 3), ["x"])


_CHANGED = ("vs AS (SELECT DISTINCT version FROM (SELECT x, version, p, lag(p, 1, 0) OVER (PARTITION BY x ORDER BY version) AS old FROM (SELECT x, version, CASE WHEN sum(d) OVER (PARTITION BY x ORDER BY version) > 0 "
            "THEN 1 ELSE 0 END AS p FROM (SELECT x, version, sum(multiplicity) AS d FROM tr GROUP BY ALL))) WHERE p <> old)")


@query("i5_version_rounds", sql(f"SELECT x, {ONE} AS multiplicity, version, CAST(min(r) AS INTEGER) AS round FROM c GROUP BY x, version", "order_churn",
                                more=_ALL_TRACE.replace("vs AS (SELECT DISTINCT version FROM tr)", _CHANGED) + "c AS (SELECT version, x, 0 AS r FROM inp UNION SELECT version, x * 2, r + 1 FROM c, top WHERE x * 2 <= t AND x > 0)", recursive=True))
def _(spark, d):
    tr, top = _all_trace(spark, d)
    # each version's input, every record once
    return I.iterate_trace_log(T.distinct_trace(tr, ["x"]), J.closure_step(top, lambda x: x * 2))


@query("i6_nested", sql(f"SELECT nation, x, {ONE} AS multiplicity FROM c", recursive=True,
                        more="top AS (SELECT max(c_custkey) AS t FROM customer), c AS (SELECT c_nationkey AS nation, CAST(c_custkey AS BIGINT) AS x FROM customer "
                             "UNION SELECT nation, x * k FROM c, top, (VALUES (2), (3)) AS f(k) WHERE x * k <= t)"))
def _(spark, d):
    """In each nation, closed under doubling within every round of tripling."""
    c = J.read(spark, d, "customer")
    seeds = S.collection(c.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").cast("bigint").alias("x")))
    top = _top(seeds)
    return I.iterate_nested(seeds, J.closure_step(top, lambda x: x * 3), J.closure_step(top, lambda x: x * 2), ["nation"])


# ---- user functions ----------------------------------------------------------------------------

@query("u1_map", sql("SELECT key, value * 2 + 1 AS value, multiplicity FROM order_churn", "order_churn"))
def _(spark, d):
    return C.map_records(J.order_churn(spark, d), "key", (F.col("value") * 2 + 1).alias("value"))


@query("u2_filter", sql("SELECT key, value, multiplicity FROM order_churn WHERE (key + value) % 3 = 0", "order_churn"))
def _(spark, d):
    return C.filter_records(J.order_churn(spark, d).drop("version"), (F.col("key") + F.col("value")) % 3 == 0)


@query("u3_reduce", sql(
    f"SELECT key, {_big('sum(value * multiplicity)')} AS total, {_big('count(*)')} AS kinds, {ONE} AS multiplicity FROM (SELECT key, value, sum(multiplicity) AS multiplicity FROM order_churn GROUP BY key, value HAVING sum(multiplicity) <> 0) GROUP BY key", "order_churn"))
def _(spark, d):
    f = lambda rows: [((sum(v[0] * m for v, m in rows), len(rows)), 1)]
    return C.reduce_groups(J.order_churn(spark, d).drop("version"), ["key"], ["value"], f, "total bigint, kinds bigint")


# ---- workload jobs -----------------------------------------------------------------------------

def _grid_sql(source: str) -> str:
    around = ", ".join(f"({i}, {j})" for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0))
    return (f"SELECT n.x, n.y FROM (SELECT s.x + o.i AS x, s.y + o.j AS y, count(*) AS k FROM {source} s, (VALUES {around}) AS o(i, j) GROUP BY 1, 2) n "
            f"LEFT JOIN {source} p ON p.x = n.x AND p.y = n.y WHERE n.k = 3 OR (n.k = 2 AND p.x IS NOT NULL)")


@query("x1_grid_step", sql(f"SELECT x, y, {ONE} AS multiplicity FROM ({_grid_sql('grid_cells')})", "grid_cells"))
def _(spark, d):
    return J.grid_step(J.grid_cells(spark, d))


@query("x2_grid_fixpoint", sql(f"SELECT x, y, {ONE} AS multiplicity FROM g3", "grid_cells",
                               more=f"g1 AS ({_grid_sql('grid_cells')}), g2 AS ({_grid_sql('g1')}), g3 AS ({_grid_sql('g2')})"))
def _(spark, d):
    return I.iterate(J.grid_cells(spark, d), J.grid_step, max_rounds=3, on_limit="return")


@query("x4_squares", sql(f"SELECT x, x * x AS square, {ONE} AS multiplicity FROM c", more=f"c AS (SELECT x FROM ({_SEEDS}) UNION SELECT x + 7 FROM c WHERE x + 7 <= 200)", recursive=True))
def _(spark, d):
    closed = I.iterate(_seeds(spark, d), J.closure_step(200, lambda x: x + 7))
    return C.map_records(closed, "x", (F.col("x") * F.col("x")).alias("square"))


_CELLS = f"cells AS (SELECT DISTINCT CAST(l_partkey AS INTEGER) AS x, CAST(l_suppkey AS INTEGER) AS y, {ONE} AS multiplicity FROM lineitem)"


@query("x1_grid_step_whole", sql(f"SELECT x, y, {ONE} AS multiplicity FROM ({_grid_sql('cells')})", more=_CELLS))
def _(spark, d):
    return J.grid_step(J.every_cell(spark, d))


@query("x2_grid_fixpoint_whole", sql(f"SELECT x, y, {ONE} AS multiplicity FROM g3", more=f"{_CELLS}, g1 AS ({_grid_sql('cells')}), g2 AS ({_grid_sql('g1')}), g3 AS ({_grid_sql('g2')})"))
def _(spark, d):
    return I.iterate(J.every_cell(spark, d), J.grid_step, max_rounds=3, on_limit="return")


@query("x4_squares_whole", sql(f"SELECT x, x * x AS square, {ONE} AS multiplicity FROM c", more=_ALL_CLOSED.format("x * 3"), recursive=True))
def _(spark, d):
    seeds, top = _all_seeds(spark, d)
    return C.map_records(I.iterate(seeds, J.closure_step(top, lambda x: x * 3)), "x", (F.col("x") * F.col("x")).alias("square"))


_EVEN = ("SELECT value, CAST(sum(m) AS BIGINT) AS multiplicity, version FROM (SELECT value + 5 AS value, multiplicity AS m, version FROM order_churn WHERE (value + 5) % 2 = 0 "
         "UNION ALL SELECT value, -multiplicity, version FROM order_churn) GROUP BY value, version HAVING sum(m) <> 0")


def even_difference(tr: DataFrame) -> DataFrame:
    """map(+5), filter(even), and the input negated."""
    moved = C.filter_records(C.map_records(tr, (F.col("value") + 5).alias("value"), versions=["version"]), F.col("value") % 2 == 0)
    return C.concat(moved, C.negate(C.map_records(tr, "value", versions=["version"])))


@query("x5_even_diff", sql(_EVEN, "order_churn"))
def _(spark, d):
    return C.consolidate(even_difference(J.order_churn(spark, d)))


_JOIN_COUNT = sql(_changes_sql("multiplicity", "count", f"({_JOINED})"), "order_trace", "line_trace")


@query("x6_join_count", _JOIN_COUNT)
def _(spark, d):
    return J.join_count(J.order_trace(spark, d), J.line_trace(spark, d), null_keys=False)


@query("x7_lines_per_customer", f"SELECT o_custkey AS customer, {_big('count(*)')} AS count, {ONE} AS multiplicity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def _(spark, d):
    return J.lines_per_customer(spark, d)


_X6_PRODUCT = ("SELECT key, count, CAST(sum(m) AS BIGINT) AS multiplicity, v0, v1 FROM (" + _FOUR.format("count") + ") WHERE count IS NOT NULL GROUP BY key, count, v0, v1 HAVING sum(m) <> 0")
_X6_JOINED = _PRODUCT_B + ", j AS (SELECT a.key, greatest(a.v0, b.v0) AS v0, greatest(a.v1, b.v1) AS v1, a.multiplicity * b.multiplicity AS multiplicity FROM order_churn2 a JOIN b ON a.key = b.key), "


@query("x6_join_count_product", sql(_X6_PRODUCT, "order_churn2", more=_X6_JOINED + _product_sql("", "count", "CAST(sum(s.multiplicity) AS BIGINT)", "j")))
def _(spark, d):
    return J.join_count(J.order_churn2(spark, d), _customers(spark, d), null_keys=False, versions=("v0", "v1"))


# ---- three coordinates, null keys, records taken back ------------------------------------------

_CHURN3 = ("b3 AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS key, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 20000) AS BIGINT) END AS value, "
           "CAST((year(o_orderdate) - 1992) // 2 AS INTEGER) AS v0, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) // 2 AS v1, CAST(month(o_orderdate) // 5 AS INTEGER) AS v2, o_orderstatus FROM orders), "
           f"t3 AS (SELECT key, value, {ONE} AS multiplicity, v0, v1, v2 FROM b3 UNION ALL SELECT key, value, CAST(-1 AS BIGINT), v0 + 1, v1, v2 + 1 FROM b3 WHERE o_orderstatus = 'F')")


def churn3(spark, d) -> DataFrame:
    """key custkey or null, value price class or null, version (years, priority, season); filled orders go one step later in two coordinates."""
    o = J.read(spark, d, "orders").select(
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("key"), F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_totalprice") / 20000).cast("bigint")).alias("value"),
        F.expr("cast((year(o_orderdate) - 1992) div 2 as int)").alias("v0"), F.expr("cast(cast(substr(o_orderpriority, 1, 1) as int) div 2 as int)").alias("v1"),
        F.expr("cast(month(o_orderdate) div 5 as int)").alias("v2"), "o_orderstatus")
    cols = ["key", "value", M, "v0", "v1", "v2"]
    gone = o.where("o_orderstatus = 'F'").withColumns({M: F.lit(-1).cast("bigint"), "v0": F.col("v0") + 1, "v2": F.col("v2") + 1})
    return S.collection(o).select(*cols).unionByName(gone.select(*cols))


def _by_axes(keys: list[str], name: str, answer: str, source: str, coords: list[str]) -> str:
    """By definition: the answer on each key's whole grid, then +1 here and -1 at the next place, along one axis after the other."""
    same = lambda a, b, cols: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols)
    k = ", ".join(keys)
    axes = ", ".join(f"a{i} AS (SELECT {k}, {c}, lead({c}) OVER (PARTITION BY {k} ORDER BY {c}) AS nxt FROM (SELECT DISTINCT {k}, {c} FROM {source}))" for i, c in enumerate(coords))
    grid = f"SELECT {', '.join('a0.' + x for x in keys)}, {', '.join(f'a{i}.{c}' for i, c in enumerate(coords))} FROM a0 " + " ".join(f"JOIN a{i} ON {same('a0', f'a{i}', keys)}" for i in range(1, len(coords)))
    upto = " AND ".join(f"s.{c} <= g.{c}" for c in coords)
    spots = ", ".join(f"g.{x}" for x in [*keys, *coords])
    steps = [f"{axes}, grid AS ({grid}), r0 AS (SELECT {spots}, {answer} AS {name}, 1 AS m FROM grid g JOIN {source} s ON {same('g', 's', keys)} AND {upto} GROUP BY ALL)"]
    for i, c in enumerate(coords):
        rest = ", ".join(f"r.{x}" for x in [*keys, *coords, name] if x != c)
        every = ", ".join([*keys, *coords, name])
        steps.append(f"r{i + 1} AS (SELECT {every}, m FROM r{i} UNION ALL SELECT {every}, m FROM (SELECT {rest}, x.nxt AS {c}, -r.m AS m FROM r{i} r JOIN a{i} x ON {same('r', 'x', keys)} AND r.{c} = x.{c} WHERE x.nxt IS NOT NULL))")
    return ", ".join(steps)


_THREE_KEPT = "SELECT CAST(key AS VARCHAR) AS key, {0}, CAST(sum(m) AS BIGINT) AS multiplicity, v0, v1, v2 FROM r3 WHERE {0} IS NOT NULL GROUP BY ALL HAVING sum(m) <> 0"


def _said(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.col("key").cast("string"))


def _extreme3(pick: str) -> str:
    """As ``_by_axes`` with the extreme of the values whose net is positive at a place of the grid."""
    axes = _by_axes(["key"], pick, "NULL", "t3", _XYZ).split(", r0 AS (")
    rest = axes[1][axes[1].index("), r1 AS (") + 1:]
    nets = ("nets AS (SELECT g.key, g.v0, g.v1, g.v2, s.value FROM grid g JOIN t3 s ON g.key IS NOT DISTINCT FROM s.key AND s.v0 <= g.v0 AND s.v1 <= g.v1 AND s.v2 <= g.v2 "
            "WHERE s.value IS NOT NULL GROUP BY ALL HAVING sum(s.multiplicity) > 0)")
    return f"{axes[0]}, {nets}, r0 AS (SELECT key, v0, v1, v2, {pick}(value) AS {pick}, 1 AS m FROM nets GROUP BY ALL){rest}"


@query("r7_count_three", sql(_THREE_KEPT.format("count"), more=_CHURN3 + ", " + _by_axes(["key"], "count", "CAST(sum(s.multiplicity) AS BIGINT)", "t3", _XYZ)))
def _(spark, d):
    return _said(T.count_product(churn3(spark, d), ["key"], _XYZ))


@query("r7_sum_three", sql(_THREE_KEPT.format("sum"), more=_CHURN3 + ", " + _by_axes(["key"], "sum", "CAST(coalesce(sum(s.value * s.multiplicity), 0) AS BIGINT)", "t3", _XYZ)))
def _(spark, d):
    return _said(T.sum_product(churn3(spark, d), ["key"], "value", _XYZ))


@query("r7_min_three", sql(_THREE_KEPT.format("min"), more=_CHURN3 + ", " + _extreme3("min")))
def _(spark, d):
    return _said(T.min_product(churn3(spark, d), ["key"], "value", _XYZ))


@query("r7_max_three", sql(_THREE_KEPT.format("max"), more=_CHURN3 + ", " + _extreme3("max")))
def _(spark, d):
    return _said(T.max_product(churn3(spark, d), ["key"], "value", _XYZ))


@query("r7_distinct_three", sql(
    "SELECT CAST(key AS VARCHAR) AS key, CAST(value AS VARCHAR) AS value, CAST(sum(m * here) AS BIGINT) AS multiplicity, v0, v1, v2 FROM r3 GROUP BY ALL HAVING sum(m * here) <> 0",
    more=_CHURN3 + ", " + _by_axes(["key", "value"], "here", "CASE WHEN sum(s.multiplicity) > 0 THEN 1 ELSE 0 END", "t3", _XYZ)))
def _(spark, d):
    return _said(T.distinct_product(churn3(spark, d), ["key", "value"], _XYZ)).withColumn("value", F.col("value").cast("string"))


@query("r7_reduce_three", sql(_THREE_KEPT.format("max"), more=_CHURN3 + ", " + _extreme3("max")))
def _(spark, d):
    largest = lambda rows: [(v, 1) for v, m in rows if m > 0 and v[0] is not None][-1:]
    return _said(T.reduce_product(churn3(spark, d), ["key"], ["value"], largest, "max bigint", _XYZ))


_X6_ODD = ("o AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS key, v0, v1, multiplicity FROM (SELECT o_custkey, CAST(year(o_orderdate) - 1995 AS INTEGER) AS v0, "
           f"CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS v1, {ONE} AS multiplicity FROM orders)), "
           f"c AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS key, c_nationkey % 7 AS v0, c_nationkey % 5 + 1 AS v1, {ONE} AS multiplicity FROM customer), "
           "ca AS (SELECT key, v0, v1, sum(multiplicity) AS multiplicity FROM c GROUP BY ALL), oa AS (SELECT key, v0, v1, sum(multiplicity) AS multiplicity FROM o GROUP BY ALL), "
           "j AS (SELECT oa.key, CAST(greatest(oa.v0, ca.v0) AS INTEGER) AS v0, CAST(greatest(oa.v1, ca.v1) AS INTEGER) AS v1, oa.multiplicity * ca.multiplicity AS multiplicity FROM oa JOIN ca ON oa.key IS NOT DISTINCT FROM ca.key), ")


@query("x6_join_count_odd", sql("SELECT CAST(key AS VARCHAR) AS key, count, CAST(sum(m) AS BIGINT) AS multiplicity, v0, v1 FROM r2 GROUP BY ALL HAVING sum(m) <> 0",
                                more=_X6_ODD + _by_axes(["key"], "count", "CAST(sum(s.multiplicity) AS BIGINT)", "j", ["v0", "v1"])))
def _(spark, d):
    odd = lambda df: df.withColumn("key", F.when(F.col("key") % 10 != 0, F.col("key")))
    return _said(J.join_count(odd(J.order_churn2(spark, d)), odd(_customers(spark, d)), versions=("v0", "v1")))
