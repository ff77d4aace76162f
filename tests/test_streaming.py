"""Streams give the batch answer: more than six versions, closed versions only, late rows aside."""

from pyspark.sql import functions as F

from tidemark import streaming as W
from tidemark.operators import trace as T
from tidemark.plans.streams import replayed

SCHEMA = "key bigint, value bigint, multiplicity bigint, version int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def churn(spark):
    out = [(k, i % 4, 1, i) for i in range(8) for k in (1, 2)] + [(1, i % 4, -1, i + 3) for i in range(4)] + [(2, 3, -2, 7)]
    return spark.createDataFrame(out, SCHEMA)


def test_count_and_min_equal_batch(spark):
    tr = churn(spark)
    assert rows(W.run_to_end(W.stream_count(replayed(tr, "t-count"), "key", "value"), "t-count")) == rows(T.count_trace(tr, ["key"]))
    assert rows(W.run_to_end(W.stream_min(replayed(tr, "t-min"), "key", "value"), "t-min")) == rows(T.min_trace(tr, ["key"], "value"))


def test_open_version_is_held_back(spark):
    tr = churn(spark)
    parts = [tr.where("version <= 3"), tr.where("version > 3")]  # no heartbeat: version 7 stays open
    got = W.run_to_end(W.stream_consolidate(W.feed(parts, "t-open"), ["key"]), "t-open")
    assert {r.version for r in got.collect()} == set(range(7)) - {v for v in range(7) if rows(T.snapshot_at(tr.where(F.col("version") == v).drop("value"), {"version": v})) == []}


def test_late_rows_are_set_aside(spark):
    tr = churn(spark)
    store = W.VersionedStore(spark, "t-late", lambda stored, low, high: stored)
    late = spark.createDataFrame([(9, 9, 1, 2)], SCHEMA)
    store.run(W.feed([tr, late], "t-late"))
    assert rows(store.late_rows(SCHEMA)) == [(9, 9, 1, 2)]


def counts(stored, low, high):
    return T.count_trace(stored, ["key"])


CHANGES = "key bigint, count bigint, multiplicity bigint, version int"


def test_store_survives_restart_replay_and_folding(spark, tmp_path):
    """A new store on the path goes on, a batch given again changes nothing, and folded history answers as before."""
    tr = churn(spark).cache()
    path = f"file://{tmp_path}/store"
    parts = [tr.where(F.col("version") == v) for v in range(8)] + [W.heartbeat(tr, 9)]
    for i, p in enumerate(parts):
        store = W.VersionedStore(spark, "t-store", counts, path=path, key=["key"], buckets=3)  # a restart before each batch
        store.batch(p, i)
        if i in (2, 5):
            before = rows(store.changes(CHANGES))
            W.VersionedStore(spark, "t-store", counts, path=path, key=["key"], buckets=3).batch(p, i)
            assert rows(store.changes(CHANGES)) == before
    assert store.frontier == 9
    runs = store._runs(store._state()["ranges"])
    assert max(r[0] for r in runs) == 1 and len(runs) <= 6  # levels, and every range in one run
    assert rows(store.changes(CHANGES)) == rows(T.count_trace(tr, ["key"]))
    store.batch(spark.createDataFrame([(9, 9, 1, 4)], SCHEMA), len(parts))
    assert rows(store.late_rows(SCHEMA)) == [(9, 9, 1, 4)]


def test_words_batches_replays_and_restarts_in_any_order(spark, tmp_path):
    """An advance is kept by the batches after it; each version is answered once; what comes too late is set aside."""
    import pytest
    tr = churn(spark).cache()
    for number, order in enumerate((["b0", "a8", "b1", "a10"], ["a3", "b0", "r0", "a8", "r0", "b1", "r1", "a10"], ["b0", "a8", "a9", "b1", "r1", "a9", "a10"])):
        path = f"file://{tmp_path}/word{number}"
        given = {"b0": tr, "b1": spark.createDataFrame([(1, 2, 1, 7), (2, 9, 1, 8), (1, 3, 1, 9)], SCHEMA)}
        kept, frontier = [], 0
        for what in order:
            store = W.VersionedStore(spark, "t-word", counts, path=path, key=["key"])
            if what[0] == "a":
                store.advance(int(what[1:]), schema=tr.schema)
                frontier = int(what[1:])
            else:
                batch = given["b" + what[1]]
                store.batch(batch, int(what[1]))
                if what[0] == "b":
                    kept += [r for r in rows(batch) if r[3] >= frontier]
                    frontier = max([frontier, *(r[3] for r in rows(batch))])
            assert store.frontier == frontier
        want = T.count_trace(spark.createDataFrame(kept, SCHEMA), ["key"])
        assert rows(store.changes(CHANGES)) == rows(want)
        assert rows(store.late_rows(SCHEMA)) == sorted(r for b in given.values() for r in rows(b) if r not in kept)
        with pytest.raises(ValueError):
            store.advance(5)


def test_a_step_without_its_line_has_not_happened(spark, tmp_path, monkeypatch):
    tr = churn(spark).cache()
    path = f"file://{tmp_path}/broken"
    store = W.VersionedStore(spark, "t-broken", counts, path=path, key=["key"])
    store.batch(tr.where("version <= 2"), 0)
    monkeypatch.setattr(store, "_line", lambda state: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        store.batch(tr.where("version > 2"), 1)
    except RuntimeError:
        pass
    again = W.VersionedStore(spark, "t-broken", counts, path=path, key=["key"])
    assert again.frontier == 2
    again.advance(4)  # takes the broken step's number
    again.batch(tr.where("version > 2"), 1)  # its rows at version 3 are late by now
    again.advance(8)
    kept = tr.where("version <= 2 or version >= 4")
    assert rows(again.changes(CHANGES)) == rows(T.count_trace(kept, ["key"]))
    assert rows(again.late_rows(SCHEMA)) == rows(tr.where("version = 3"))


def test_only_touched_buckets_are_opened(spark):
    """A batch of one key reads that key's bucket: its history is scanned under a filter on the folders."""
    seen = []

    def noted(stored, low, high):
        plan = stored._jdf.queryExecution().executedPlan().toString()
        seen.append([x.split("PartitionFilters: [")[1].split("]")[0] for x in plan.split("FileScan")[1:] if "PartitionFilters: [" in x])
        return counts(stored, low, high)

    store = W.VersionedStore(spark, "t-buckets", noted, key=["key"], buckets=16)
    many = spark.range(64).selectExpr("id as key", "id as value", "1L as multiplicity", "0 as version")
    store.batch(many, 0)
    store.batch(spark.createDataFrame([(5, 1, 1, 1)], SCHEMA), 1)
    store.batch(spark.createDataFrame([(5, 2, 1, 2)], SCHEMA), 2)
    store.advance(3)
    assert any(f.startswith("(_bucket#") or "_bucket#" in f and " = " in f for f in seen[-1])
    assert (5, 3, 1, 2) in rows(store.changes(CHANGES))


def test_product_order_by_words(spark):
    """Antichains: answers at bounds of versions that closed at different times come when the bound closes."""
    from tidemark.functions import versions as V
    import random
    r = random.Random(4)
    schema = "key bigint, value bigint, multiplicity bigint, v0 int, v1 int"
    data = [(r.choice([1, 2, None]), r.randrange(3), 1, r.randrange(4), r.randrange(4)) for _ in range(60)]
    tr = spark.createDataFrame(data, schema).cache()
    store = W.VersionedStore(spark, "t-product", lambda stored, low, high: T.count_product(stored, ["key"]), key=["key"], coords=("v0", "v1"), buckets=4)
    frontiers = [[(1, 0), (0, 2)], [(2, 0), (1, 2), (0, 3)], [(2, 1), (1, 3)], [(4, 1), (1, 4)], [(4, 2), (2, 4)], [(4, 4)]]
    was = [(0, 0)]
    for i, f in enumerate(frontiers):
        store.batch(tr.where(V.open_at(["v0", "v1"], was) & ~V.open_at(["v0", "v1"], f)), i)
        store.advance(f)
        was = f
    done = [tuple(r) for r in T.count_product(tr, ["key"]).where("v0 < 4 and v1 < 4").collect()]
    key = lambda x: repr(x)
    assert sorted(map(tuple, store.changes("key bigint, count bigint, multiplicity bigint, v0 int, v1 int").collect()), key=key) == sorted(done, key=key)
    store.batch(spark.createDataFrame([(1, 1, 1, 3, 3), (1, 1, 1, 4, 4)], schema), len(frontiers))
    assert rows(store.late_rows(schema)) == [(1, 1, 1, 3, 3)]


def test_streamed_changes_replace_a_replayed_batch(spark, tmp_path):
    from tidemark import sources as S
    tr = churn(spark).cache()
    path = f"file://{tmp_path}/deltas"
    stream = W.feed([tr.where("version <= 3"), tr.where("version > 3")], "t-sink")
    writer = S.write_stream_deltas(stream, path)
    writer.option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    # a checkpoint that was lost: all batches are given again
    S.write_stream_deltas(stream, path).option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert rows(S.read_deltas(spark, path, SCHEMA)) == rows(tr)


def test_two_inputs_close_what_both_have_closed(spark):
    tr = churn(spark)
    sided = tr.withColumn("side", (F.col("key") == 2).cast("int"))
    store = W.VersionedStore(spark, "t-meet", lambda stored, low, high: stored, side="side", sides=2)
    store.batch(sided.where("side = 0"), 0)
    assert store.frontier == 0
    store.batch(sided.where("side = 1 and version <= 3"), 1)
    assert store.frontier == 3 and {r.version for r in store.changes(sided.schema).collect()} == {0, 1, 2}
    a, b = tr.where("key = 1"), tr.where("key = 2 and version <= 4")
    out = W.run_to_end(W.stream_concat(W.feed([a.where("version <= 5"), a.where("version > 5")], "t-a"), W.feed([b.where("version <= 2"), b.where("version > 2")], "t-b"), ["key"]), "t-two")
    assert {r.version for r in out.collect()} <= set(range(4)) and out.count() > 0


def test_closed_through_tells_the_watermark(spark):
    from tidemark.scratch import new_folder
    stream = W.event_time(W.feed([churn(spark)], "t-through"))
    query = (stream.groupBy("et").agg(F.sum("multiplicity").alias("m")).writeStream.format("memory").queryName("t_through")
             .option("checkpointLocation", new_folder(spark, "t-through")).outputMode("append").start())
    try:
        assert W.closed_through(query).startswith("1970-01-01T00:00:07")
    finally:
        query.stop()


def test_running_answers_are_jobs_over_stored_rows(spark, tmp_path):
    """No call of Python a row: a batch is a job.  A second run on the path adds nothing, and emptied keys are asked if wanted."""
    tr = spark.createDataFrame([(1, 5, 1, 0), (1, 6, 1, 0), (1, 5, -1, 3), (1, 6, -1, 3), (2, 7, 1, 1), (2, 7, -1, 1), (1, 8, 2, 9)], SCHEMA)
    size = lambda rows: [((sum(m for _, m in rows),), 1)]
    path = f"file://{tmp_path}/running"
    answers = W.stream_reduce(replayed(tr, "t-running"), "key", "value", size, "n bigint", empty_too=True)
    want = [(1, 0, -1, 9), (1, 0, 1, 3), (1, 2, -1, 3), (1, 2, 1, 0), (1, 2, 1, 9), (2, 0, 1, 1)]
    assert rows(answers.run("t-running", path)) == want
    assert rows(answers.run("t-running", path)) == want
    assert answers.store("t-running", path).frontier == 10
    some = W.stream_reduce(replayed(tr, "t-some"), "key", "value", size, "n bigint")
    assert rows(W.run_to_end(some, "t-some")) == [r for r in want if r[1]]


def test_streams_join_over_tables(spark, tmp_path):
    """Both histories are tables that a batch joins; a second run on the path adds nothing, a lost checkpoint replaces what is there."""
    from tidemark.scratch import drop_folder
    a = spark.createDataFrame([(1, 5, 1, 0), (None, 6, 1, 1), (1, 7, -1, 4)], SCHEMA)
    b = spark.createDataFrame([(1, 50, 1, 3), (None, 60, 2, 0), (1, 50, -1, 5)], SCHEMA).withColumnRenamed("value", "batch")
    joined = W.stream_join(W.feed([a.where("version < 2"), a.where("version >= 2")], "t-left"), W.feed([b.where("version < 4"), b.where("version >= 4")], "t-right"), ["key"])
    want = T.join_trace(a, b, ["key"]).select("key", "value", "batch", "version", "multiplicity")
    in_order = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    path = f"file://{tmp_path}/joined"
    assert in_order(joined.run("t-joined", path)) == in_order(want)
    drop_folder(spark, f"{path}/checkpoint")
    assert in_order(joined.run("t-joined", path)) == in_order(want)


def test_a_replay_reads_the_trace_a_fixed_number_of_times(spark):
    """However many batches: the source is scanned for its versions and once more to be dealt, and not for each batch."""
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    tr = spark.range(40).selectExpr("id % 3 as key", "id as value", "1L as multiplicity", "cast(id as int) as version")
    stream = replayed(tr.mapInArrow(noted, tr.schema), "t-replay", 5)
    assert seen.value <= 2 * 40
    out = W.run_to_end(stream, "t-replay").where("multiplicity <> 0")
    assert rows(out) == rows(tr)
