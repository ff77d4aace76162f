"""Fixpoints kept under change: what a change does not reach is not computed again.

``IncrementalFixpoint`` keeps x = distinct(linear(x)), begun at the input, as changes at (version, round),
which are ordered by product.  Round i + 1 holds what ``distinct`` makes of ``linear`` of round i; a record's
presence may change where one of its own changes lies, or at the least upper bound of two of them.
So a round looks at the records that it just changed, and at those that this update changed before
and that have changes of that very round from earlier updates; for each it reads the record's own
history and nothing else.  The answer's changes are those of all rounds together.  Deletions and
changes at versions in between are changes like others.

The history lies in folders by hash of the record: a round opens those of the records it looks at.
``linear`` must be linear in multiplicities (map, filter, negate, concat, joins with fixed tables) and
carry the columns ``version`` and ``multiplicity`` along.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators.collection import consolidate, negate
from tidemark.scratch import drop_folder, new_folder, saved
from tidemark.sources import M

FAN = 8


class IncrementalFixpoint:
    """``update`` takes changes of the input and returns the changes of the fixpoint."""

    def __init__(self, spark: SparkSession, name: str, linear: Callable[[DataFrame], DataFrame], cols: Sequence[str], path: str | None = None, buckets: int = 32, max_rounds: int = 1000):
        self.spark, self.linear, self.cols, self.buckets, self.max_rounds = spark, linear, list(cols), buckets, max_rounds
        self.path = path or new_folder(spark, name)
        self.looked_at: list[int] = []  # records that each round of the last update looked at

    def _who(self):
        return F.struct(*[F.col(c) for c in self.cols])  # never null; null fields equal each other

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(c) for c in self.cols]), F.lit(self.buckets)).cast("int")

    def _runs(self, before: int) -> list[tuple[int, int]]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(hadoop):
            return []
        names = [f.getPath().getName() for f in files.listStatus(hadoop)]
        names = [n for n in names if n.startswith("run=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        found = sorted(tuple(map(int, n[4:].split("-"))) for n in names)
        found = [r for r in found if r[1] < before]
        return [r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found)]

    def _history(self, schema, before: int, buckets: list[int]) -> DataFrame:
        """(cols, version, round, multiplicity) of updates before the given one."""
        runs = self._runs(before)
        if not runs or not buckets:
            return self.spark.createDataFrame([], schema)
        out = None
        for a, b in runs:
            one = self.spark.read.schema(self._with_bucket(schema)).parquet(f"{self.path}/run={a}-{b}").where(F.col("_bucket").isin(buckets)).drop("_bucket")
            out = one if out is None else out.unionByName(one)
        return out

    @staticmethod
    def _with_bucket(schema):
        from pyspark.sql.types import IntegerType, StructType
        return StructType([*schema.fields]).add("_bucket", IntegerType())

    def _jumps(self, history: DataFrame, i: int) -> DataFrame:
        """Changes at round i of presence, by all changes less by those known before (``_old``)."""
        part = lambda upto, old: F.coalesce(F.sum(F.when((F.col("round") <= upto) & (F.col("_old") if old else F.lit(True)), F.col(M))), F.lit(0))
        sums = history.groupBy(*self.cols, "version").agg(part(i, False).alias("a"), part(i - 1, False).alias("b"), part(i, True).alias("c"), part(i - 1, True).alias("d"))
        w = Window.partitionBy(*self.cols).orderBy("version")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.select(*self.cols, "version", *[F.sum(x).over(upto).alias(x) for x in "abcd"])
        there = lambda x: (F.col(x) > 0).cast("bigint")
        checked = F.when(F.col("a") < 0, F.raise_error(F.lit("negative net multiplicity"))).otherwise(there("a"))
        steps = sums.select(*self.cols, "version", (checked - there("b") - there("c") + there("d")).alias("_z"))
        steps = steps.withColumn(M, F.col("_z") - F.lag("_z", 1, 0).over(w)).where(F.col(M) != 0)
        return steps.select(*self.cols, M, "version")

    def update(self, changes: DataFrame, number: int | None = None) -> DataFrame:
        """Changes of the answer that ``changes(cols, multiplicity, version)`` make.

        ``number`` names the update (they ascend); one that is given again replaces what it left.
        """
        if number is None:
            runs = self._runs(1 << 60)
            number = runs[-1][1] + 1 if runs else 0
        start = saved(consolidate(changes.select(*self.cols, M, "version")), "change")
        now, i, last, own, out, looked = start, 0, -1, None, None, []
        known = None  # records that this update has changed so far
        while True:
            made = saved(consolidate(self.linear(now).select(*self.cols, M, "version")).withColumn("round", F.lit(i)), "made")
            schema = made.schema
            own = made if own is None else own.unionByName(made)
            fresh = made.select(self._who().alias("_k"), self._bucket().alias("_b")).distinct()
            if self._runs(number):
                # earlier changes of all records of this update; those of this round schedule a look
                everyone = saved((fresh if known is None else known.unionByName(fresh)).distinct(), "known")
                buckets = sorted(r._b for r in everyone.select("_b").distinct().collect())  # at most as many as there are buckets
                earlier = self._history(schema, number, buckets).join(everyone.select(F.col("_k").alias("_t")), self._who() == F.col("_t"), "left_semi")
                last = earlier.agg(F.max("round")).first()[0]
                due = saved(fresh.select("_k").unionByName(earlier.where(F.col("round") == i).select(self._who().alias("_k"))).distinct(), "due")
                known = everyone
            else:
                earlier, last, due = self.spark.createDataFrame([], schema), None, fresh.select("_k")
            history = earlier.withColumn("_old", F.lit(True)).unionByName(own.withColumn("_old", F.lit(False))).where(F.col("round") <= i)
            jumps = saved(self._jumps(history.join(due.withColumnRenamed("_k", "_t"), self._who() == F.col("_t"), "left_semi"), i), "jumps")
            looked.append(due.count())
            out = jumps if out is None else out.unionByName(jumps)
            now = jumps if i else jumps.unionByName(negate(start))
            i += 1
            if (last is None or last < i) and consolidate(now).isEmpty():
                break
            if i > self.max_rounds:
                raise RuntimeError(f"no fixpoint within {self.max_rounds} rounds")
        self.looked_at = looked
        own.where(F.col(M) != 0).withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/run={number}-{number}")
        self._fold(own.schema, number)
        return consolidate(out)

    def _fold(self, schema, number: int) -> None:
        """``FAN`` runs before the last become one."""
        runs = self._runs(number)
        if len(runs) < FAN:
            return
        out = consolidate(self._history(schema, number, list(range(self.buckets))))
        out.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/run={runs[0][0]}-{runs[-1][1]}")
        for a, b in runs:
            if (a, b) != (runs[0][0], runs[-1][1]):
                drop_folder(self.spark, f"{self.path}/run={a}-{b}")


def iterate_changes(tr: DataFrame, linear: Callable[[DataFrame], DataFrame], cols: Sequence[str], max_rounds: int = 1000) -> DataFrame:
    """Changes of the fixpoint at every version of a trace: each version pays for what it changes."""
    return IncrementalFixpoint(tr.sparkSession, "fixpoint", linear, cols, max_rounds=max_rounds).update(tr)
