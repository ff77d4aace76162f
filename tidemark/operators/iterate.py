"""Fixpoints as driver loops of DataFrame jobs.

Each round is written to the shared scratch folder and read back (lineage stays short, a lost
executor costs a re-read).  A loop ends when consolidated contents are equal, not row counts.  A
loop body maps a collection to a collection and consolidates it, usually by ending in ``distinct``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.collection import consolidate, difference
from tidemark.operators.trace import snapshots
from tidemark.scratch import discard, saved
from tidemark.sources import M

Body = Callable[[DataFrame], DataFrame]


def _limit(rounds: int, max_rounds: int, on_limit: str) -> bool:
    if rounds < max_rounds:
        return False
    if on_limit == "raise":
        raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
    return True


def _mark(df: DataFrame) -> tuple:
    """Rows and a hash sum: two tables that differ here differ; equal marks still want a comparison."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))).first())


def iterate(df: DataFrame, f: Body, max_rounds: int = 100, on_limit: str = "raise") -> DataFrame:
    """f applied until nothing changes; ``on_limit='return'`` gives what ``max_rounds`` rounds give.

    Rounds are told apart by their marks; only where these agree are the contents compared.  A round's
    table goes once the next but one is written.
    """
    now = saved(consolidate(df), "round")
    mark, old, rounds = _mark(now), None, 0
    while not _limit(rounds, max_rounds, on_limit):
        new = saved(consolidate(f(now)), "round")
        rounds += 1
        was, mark = mark, _mark(new)
        if was == mark and difference(new, now).isEmpty():
            return new
        if old is not None:
            discard(old)
        old, now = now, new
    return now


def iterate_insert_only(df: DataFrame, step: Body, max_rounds: int = 1000) -> DataFrame:
    """All records that ``step`` reaches from ``df`` (monotone, insert-only): only new ones go on.

    Each round's new records are a table of their own; what has been seen is all of them, never rewritten.
    """
    cols = [c for c in df.columns if c != M]
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in cols]
    new = saved(df.select(*cols).distinct(), "new")
    paths, spark = [new._scratch_path], df.sparkSession
    for _ in range(max_rounds):
        seen = spark.read.schema(new.schema).parquet(*paths)
        found = step(new.withColumn(M, F.lit(1).cast("bigint"))).select(*cols).distinct()
        new = saved(found.join(seen, same(found, seen), "left_anti"), "new")
        if new.isEmpty():
            return seen.withColumn(M, F.lit(1).cast("bigint"))
        paths.append(new._scratch_path)
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")


def iterate_log(df: DataFrame, f: Body, max_rounds: int = 100, on_limit: str = "raise") -> DataFrame:
    """The changes that each round makes, labelled by ``round``; round 0 is the input."""
    now = saved(consolidate(df), "round")
    log = now.withColumn("round", F.lit(0))
    rounds = 0
    while not _limit(rounds, max_rounds, on_limit):
        new = saved(consolidate(f(now)), "round")
        rounds += 1
        change = saved(difference(new, now), "change")
        if change.isEmpty():
            break
        log = log.unionByName(change.withColumn("round", F.lit(rounds)))
        now = new
    return log


def at_change_versions(tr: DataFrame, version: str = "version") -> DataFrame:
    """Snapshots at each version that changes anything, with the version as a column of the record."""
    record = [c for c in tr.columns if c not in (M, version)]
    # places of the versions that occur: intervals are spread over these, not over every integer between
    placed = saved(tr.select(version).distinct().withColumn("_place", F.row_number().over(Window.orderBy(version))), "places")
    last = placed.agg(F.max("_place")).first()[0] or 0
    spans = snapshots(tr.join(placed, version).drop(version), "_place")
    every = spans.select(*record, M, F.explode(F.sequence("valid_from", F.coalesce(F.col("valid_to") - 1, F.lit(last)))).alias("_place"))
    return every.join(placed, "_place").select(*record, M, version)


def iterate_trace_log(tr: DataFrame, f: Body, version: str = "version", max_rounds: int = 100, on_limit: str = "raise") -> DataFrame:
    """The changes that each round makes at each version, labelled by version and ``round``."""
    return iterate_log(at_change_versions(tr, version), f, max_rounds, on_limit)


def iterate_trace(tr: DataFrame, f: Body, version: str = "version", max_rounds: int = 100, on_limit: str = "raise") -> DataFrame:
    """Changes of the fixpoint at every version, by one loop over all versions at once.

    ``on_limit='return'`` takes what ``max_rounds`` rounds give where a version has not settled.

    ``f`` may be any function of a collection; it sees the version as a column of the record and must carry it.  A version leaves the loop
    once a round no longer changes it.  (``incremental.iterate_changes`` is for a linear ``f``: there a version pays for its changes only.)  Answers start from each version's own input, so deletions
    are right for any ``f``.
    """
    versions = saved(tr.select(version).distinct(), "versions")
    answers = iterate_scoped(at_change_versions(tr, version), f, [version], max_rounds, on_limit)
    return _along_versions(answers, versions, version)


def iterate_scoped(df: DataFrame, f: Body, scope: Sequence[str], max_rounds: int = 100, on_limit: str = "raise") -> DataFrame:
    """A fixpoint in each scope (the values of some columns, which ``f`` carries), by one loop over all of them.

    A scope leaves the loop once a round no longer changes it.  ``on_limit='return'`` takes what
    ``max_rounds`` rounds give where a scope has not settled.  Null is a scope like others.
    """
    who = F.struct(*[F.col(c) for c in scope])
    now = saved(consolidate(df), "round")
    done, rounds = None, 0
    while not _limit(rounds, max_rounds, on_limit):
        new = saved(consolidate(f(now)), "round")
        rounds += 1
        moving = saved(difference(new, now).select(who.alias("_scope")).distinct(), "moving")
        still = new.join(moving, who == F.col("_scope"), "left_anti")
        done = still if done is None else done.unionByName(still)
        if moving.isEmpty():
            return done
        now = saved(new.join(moving, who == F.col("_scope"), "left_semi"), "round")
    return now if done is None else done.unionByName(now)


def iterate_nested(df: DataFrame, outer: Body, inner: Body, scope: Sequence[str], max_rounds: int = 100) -> DataFrame:
    """A loop within a loop: each outer round takes ``outer`` of what it has and runs ``inner`` on that to its own fixpoint.

    The inner loop runs for all scopes at once and each leaves it when it has settled; a scope that a whole outer
    round does not change leaves the outer loop too, and its inner loop is not run again.
    """
    return iterate_scoped(df, lambda now: iterate_scoped(outer(now), inner, scope, max_rounds), scope, max_rounds)


def _along_versions(answers: DataFrame, versions: DataFrame, version: str) -> DataFrame:
    """Differences from one version to the next: +m where an answer begins, -m where it ends."""
    record = [c for c in answers.columns if c not in (M, version)]
    nxt = versions.withColumn("_next", F.lead(version).over(Window.orderBy(version)))  # one row a version
    ends = answers.join(nxt, version).where("_next is not null").select(*record, (-F.col(M)).alias(M), F.col("_next").alias(version))
    return consolidate(answers.select(*record, M, version).unionByName(ends))
