"""Change logs kept as tables, with a ledger of frontiers: late rows, chains, fixpoints, restarts.

A store takes micro-batches and words (``advance``) as *steps*, numbered in one sequence of their own,
apart from batch ids.  Each step writes its tables and last of all its line in the ledger, which
says what all inputs have closed so far, the last batch taken, and how many ranges are answered.  A step
without a line has not happened: the next one takes its number and overwrites what it left.  A batch
that the ledger has is not taken twice, so batches, words, replays and restarts may follow in any order.

A frontier is an antichain of versions: a version is open while it is at or above one of them, and
closed otherwise.  With one coordinate a batch closes what lies below the greatest version that
it brings; with several, which are ordered by product, only a word closes.  With ``side``, a column
that names the input of a row, a version is closed when all ``sides`` inputs have closed it.

Rows at closed versions are late and set aside.  Open rows wait in one table; when a range of
versions closes, its rows become a run of the history, bucketed by key, and ``answer`` makes the range's
changes, which are kept under the range's number.  It sees the rows of the keys that the range touches only, and
only their buckets are read.  With several coordinates an answer may also change at least upper bounds of
versions that closed at different times: such points wait in a table of their own and touch their key when they
close.  ``FAN`` runs of a level merge to one of the next, where (with one coordinate) their versions fold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.versions import below, minimal_of, open_at
from tidemark.operators.collection import consolidate
from tidemark.operators.product import lub_closure
from tidemark.scratch import drop_folder, new_folder
from tidemark.sources import M

FAN = 4
Frontier = list[tuple[int, ...]]


class VersionedStore:
    """``answer(stored, low, high)`` gives changes; with one coordinate low and high are versions (low: None at first), else antichains.

    ``keeps_state`` says that the answer has tables of its own (``IncrementalFixpoint``): it then sees the range's rows only, and the range's number as a fourth argument.
    """

    def __init__(self, spark: SparkSession, name: str, answer: Callable[[DataFrame, object, object], DataFrame], path: str | None = None, key: Sequence[str] = (),
                 coords: Sequence[str] = ("version",), side: str | None = None, sides: int = 1, buckets: int = 32, keeps_state: bool = False):
        if len(coords) > 1 and not key:
            raise ValueError("partially ordered versions need the key whose answers change at their bounds")
        self.spark, self.answer, self.key, self.coords, self.side, self.sides, self.buckets = spark, answer, list(key), list(coords), side, sides, buckets
        self.path, self.keeps_state = path or new_folder(spark, name), keeps_state

    # ---- files -----------------------------------------------------------------------------------

    def _listed(self, folder: str, mark: str) -> list[str]:
        """Names below ``folder`` that begin with ``mark`` and are written to the end, without it."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(hadoop):
            return []
        names = [f.getPath().getName() for f in files.listStatus(hadoop)]
        done = lambda n: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/{n}/_SUCCESS"))
        return [n[len(mark):] for n in names if n.startswith(mark) and done(n)]

    def _write(self, df: DataFrame, at: str, *by: str) -> None:
        (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(f"{self.path}/{at}")

    def _read(self, schema, *at: str) -> DataFrame:
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in at])

    # ---- the ledger ------------------------------------------------------------------------------

    def _state(self) -> dict:
        """What the ledger's last line says: step, batch, ranges, and each input's frontier."""
        steps = sorted(map(int, self._listed("ledger", "step=")))
        if not steps:
            return {"step": -1, "batch": -1, "ranges": 0, "word": {}}
        rows = self.spark.read.schema("side string, element array<int>, batch bigint, ranges int").parquet(f"{self.path}/ledger/step={steps[-1]}").collect()  # a row an element
        word: dict[str, Frontier] = {}
        for r in rows:
            if r.side is not None:
                word.setdefault(r.side, []).append(tuple(r.element))
        return {"step": steps[-1], "batch": rows[0].batch, "ranges": rows[0].ranges, "word": word}

    def _meet(self, word: dict[str, Frontier]) -> Frontier | None:
        """The frontier of all inputs; None while one of them has not spoken."""
        return minimal_of([e for f in word.values() for e in f]) if len(word) >= self.sides else None

    @property
    def frontier(self):
        """A version with one coordinate (0 before any), else an antichain."""
        meet = self._meet(self._state()["word"])
        return meet if len(self.coords) > 1 else meet[0][0] if meet else 0

    def _line(self, state: dict) -> None:
        rows = [(s, list(e), state["batch"], state["ranges"]) for s, f in sorted(state["word"].items()) for e in f] or [(None, None, state["batch"], state["ranges"])]
        self._write(self.spark.createDataFrame(rows, "side string, element array<int>, batch bigint, ranges int").coalesce(1), f"ledger/step={state['step']}")

    # ---- steps -----------------------------------------------------------------------------------

    def batch(self, df: DataFrame, batch_id: int) -> None:
        """Takes a micro-batch, once: sets late rows aside and answers what closed."""
        state = self._state()
        if batch_id <= state["batch"]:
            return
        df = df.persist()
        try:
            was = self._meet(state["word"])
            real = df.where(F.col(M) != 0)  # heartbeats only move the frontier
            is_open = open_at(self.coords, was) if was is not None else F.lit(True)
            step = state["step"] + 1
            word = dict(state["word"])
            who = F.col(self.side).cast("string") if self.side else F.lit("")
            seen = F.max(self.coords[0]) if len(self.coords) == 1 else F.lit(None)
            heard = df.groupBy(who.alias("side")).agg(seen.alias("seen"), F.count(F.when((F.col(M) != 0) & ~is_open, 1)).alias("late")).collect()  # a row an input
            for r in heard:
                if r.seen is not None:
                    word[r.side] = [(max(r.seen, word[r.side][0][0]) if r.side in word else r.seen,)]
            if any(r.late for r in heard):
                self._write(real.where(~is_open), f"late/step={step}")
            else:
                drop_folder(self.spark, f"{self.path}/late/step={step}")  # of a batch that did not come to its end
            self._step(state, df.schema, real.where(is_open), {**state, "step": step, "batch": batch_id, "word": word})
        finally:
            df.unpersist()

    def advance(self, version, side: str = "", schema=None) -> None:
        """Declares closed all versions of an input that are not at or above ``version`` (an antichain with several coordinates).

        A frontier never moves back.  ``schema`` is needed only before the first batch.
        """
        new = [(version,)] if len(self.coords) == 1 else minimal_of([tuple(v) for v in version])
        state = self._state()
        old = state["word"].get(side)
        if old is not None and not all(any(below(f, e) for f in old) for e in new):
            raise ValueError(f"the frontier is at {old} and cannot move back to {new}")
        step = state["step"] + 1
        drop_folder(self.spark, f"{self.path}/late/step={step}")  # of a batch that did not come to its end
        schema = schema or (self.spark.read.parquet(f"{self.path}/open/step={state['step']}").schema if state["step"] >= 0 else None)
        if schema is None:
            raise ValueError("nothing has arrived yet: say the schema")
        self._step(state, schema, self.spark.createDataFrame([], schema), {**state, "step": step, "word": {**state["word"], side: new}})

    def _step(self, was: dict, schema, fresh: DataFrame, now: dict) -> None:
        low, high = self._meet(was["word"]), self._meet(now["word"])
        waiting = self._read(schema, *([f"open/step={was['step']}"] if was["step"] >= 0 else [])).unionByName(fresh)
        step, n = now["step"], was["ranges"]
        if high is None or high == low:
            self._write(waiting, f"open/step={step}")
            if self.key and len(self.coords) > 1 and was["step"] >= 0 and self._listed("due", f"step={was['step']}"):
                self._write(self._due(was["step"], schema), f"due/step={step}")
        else:
            still = open_at(self.coords, high)
            self._write(waiting.where(still), f"open/step={step}")
            self._write(self._bucketed(waiting.where(~still)), f"trace/run=0-{n}-{n}", "_bucket")
            stored = self._only(schema, n) if self.keeps_state else self._touched(schema, n, was["step"], step, high)
            ends = (low, high) if len(self.coords) > 1 else (low[0][0] if low else None, high[0][0])
            newly = ~still if low is None else open_at(self.coords, low) & ~still
            changes = self.answer(stored, *ends, n) if self.keeps_state else self.answer(stored, *ends)
            self._write(changes.where(newly), f"changes/range={n}")
            now = {**now, "ranges": n + 1}
        self._line(now)
        if now["ranges"] > n:
            self._fold(schema, now["ranges"], high)
        for name in ("open", "due"):
            drop_folder(self.spark, f"{self.path}/{name}/step={step - 2}")  # the line before still reads the one before

    # ---- history ---------------------------------------------------------------------------------

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.key]), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        """Dealt by bucket, a file each; Spark splits a bucket that is too large for one task."""
        return df.withColumn("_bucket", self._bucket()).hint("rebalance", F.col("_bucket"))

    def _runs(self, ranges: int) -> list[tuple[int, int, int]]:
        """(level, first range, last range) of the runs of ``ranges`` ranges; a merged run stands for those within it."""
        found = sorted(tuple(map(int, n.split("-"))) for n in self._listed("trace", "run="))
        found = [r for r in found if r[2] < ranges]
        return [r for r in found if not any(o != r and o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found)]

    def history(self, schema, ranges: int, buckets: list[int] | None = None) -> DataFrame:
        """Closed rows of the first ``ranges`` ranges; of some buckets only, if given: others are not opened."""
        parts = None
        for run in self._runs(ranges):
            df = self.spark.read.schema(self._with_bucket(schema)).parquet(f"{self.path}/trace/run={'-'.join(map(str, run))}")
            df = df if buckets is None else df.where(F.col("_bucket").isin(buckets))
            parts = df if parts is None else parts.unionByName(df)
        return self.spark.createDataFrame([], schema) if parts is None else parts.drop("_bucket")

    @staticmethod
    def _with_bucket(schema):
        from pyspark.sql.types import IntegerType, StructType
        return StructType([*schema.fields]).add("_bucket", IntegerType())

    def _key_struct(self):
        return F.struct(*[F.col(k) for k in self.key])

    def _touched(self, schema, n: int, before: int, step: int, high: Frontier) -> DataFrame:
        """The history, range n included, of the keys that the range touches; bounds that stay open are noted."""
        if not self.key:
            return self._folded(self.history(schema, n), n).unionByName(self._only(schema, n))
        new = self._only(schema, n)
        touched = new.select(self._key_struct().alias("_k"), self._bucket().alias("_b")).distinct()
        if len(self.coords) > 1:
            due = self._due(before, schema)
            closing = due.where(~open_at(self.coords, high))
            touched = touched.unionByName(closing.select("_k", "_b")).distinct()
        buckets = sorted(r._b for r in touched.select("_b").distinct().collect())  # at most as many as there are buckets
        own = self.history(schema, n + (len(self.coords) > 1), buckets).join(touched.select(F.col("_k").alias("_t")), self._key_struct() == F.col("_t"), "left_semi")
        if len(self.coords) == 1:
            own = self._folded(own, n).unionByName(new)  # only what is touched is folded
        else:
            bounds = lub_closure(own.select(self._key_struct().alias("_k"), *self.coords), self.coords).where(open_at(self.coords, high))
            noted = bounds.withColumn("_b", F.pmod(F.xxhash64(*[F.col("_k")[k] for k in self.key]), F.lit(self.buckets)).cast("int"))
            rest = due.where(open_at(self.coords, high)).select(*noted.columns)
            self._write(noted.unionByName(rest).distinct(), f"due/step={step}")
        return own

    def _due(self, step: int, schema) -> DataFrame:
        """(_k, *coords, _b): open bounds of closed versions."""
        from pyspark.sql.types import IntegerType, StructType
        types = {f.name: f.dataType for f in schema.fields}
        kind = StructType().add("_k", StructType([f for k in self.key for f in schema.fields if f.name == k]))
        for c in self.coords:
            kind = kind.add(c, types[c])
        kind = kind.add("_b", IntegerType())
        return self._read(kind, *([f"due/step={step}"] if step >= 0 and str(step) in self._listed("due", "step=") else []))

    def _only(self, schema, n: int) -> DataFrame:
        return self.spark.read.schema(self._with_bucket(schema)).parquet(f"{self.path}/trace/run=0-{n}-{n}").drop("_bucket")

    def _folded(self, df: DataFrame, n: int) -> DataFrame:
        """With one coordinate, history before the present range counts as of the version before it."""
        meet = self._meet(self._state()["word"])
        return self._netted(df, meet) if n and meet and len(self.coords) == 1 else df

    def _netted(self, df: DataFrame, high: Frontier) -> DataFrame:
        """Net rows, with one coordinate as of the version before the frontier.

        A key (of an input) whose records all cancelled keeps one row with multiplicity 0: its count is 0 and not unknown.
        """
        if len(self.coords) == 1:
            kind = dict(df.dtypes)[self.coords[0]]
            df = df.withColumn(self.coords[0], F.greatest(self.coords[0], F.lit(high[0][0] - 1)).cast(kind))
        if not self.key:
            return consolidate(df)
        record = [c for c in df.columns if c != M]
        nets = df.groupBy(*record).agg(F.sum(M).alias(M)).select(*df.columns)
        there = [*self.key, *([self.side] if self.side else [])]
        who = F.struct(*[F.col(c) for c in there])
        gone = nets.where(F.col(M) == 0).dropDuplicates(there).withColumn("_t", who)
        live = nets.where(F.col(M) != 0)
        return live.unionByName(gone.join(live.select(who.alias("_t")).distinct(), "_t", "left_anti").drop("_t"))

    def _fold(self, schema, ranges: int, high: Frontier) -> None:
        """``FAN`` neighbouring runs of a level become one of the next level."""
        level = 0
        while len(runs := [r for r in self._runs(ranges) if r[0] == level]) >= FAN:
            names = [f"trace/run={'-'.join(map(str, r))}" for r in runs]
            df = None
            for x in names:
                one = self.spark.read.schema(self._with_bucket(schema)).parquet(f"{self.path}/{x}").drop("_bucket")
                df = one if df is None else df.unionByName(one)
            df = self._netted(df, high)
            self._write(self._bucketed(df), f"trace/run={level + 1}-{runs[0][1]}-{runs[-1][2]}", "_bucket")
            for x in names:
                drop_folder(self.spark, f"{self.path}/{x}")
            level += 1

    # ---- use -------------------------------------------------------------------------------------

    def run(self, stream: DataFrame) -> "VersionedStore":
        """Takes all that has arrived; a store on the same path goes on where the last one ended."""
        query = (stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
        return self

    def changes(self, schema) -> DataFrame:
        """All answers so far, each closed range's once."""
        return self._read(schema, *[f"changes/range={n}" for n in range(self._state()["ranges"])])

    def late_rows(self, schema) -> DataFrame:
        last = self._state()["step"]
        return self._read(schema, *[f"late/step={n}" for n in sorted(map(int, self._listed("late", "step="))) if n <= last])
