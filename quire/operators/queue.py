"""Job queues, usage and event logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def poll(jobs: DataFrame, state: str, created: str, key: str, n: int = 1) -> DataFrame:
    """The oldest jobs in the state; ties by key."""
    return jobs.where(F.col("state") == state).orderBy(F.asc_nulls_first(created), key).limit(n)


def batch_state(jobs: DataFrame, by: str) -> DataFrame:
    """State of each batch from its jobs': paused, queued, failed, cancelled, else completed."""
    counts = {s: F.count_if(F.col("state") == s) for s in ("paused", "queued", "failed", "cancelled")}
    out = F.lit(None).cast("string")
    for s, n in reversed(counts.items()):
        out = F.when(n > 0, s).otherwise(out)
    return jobs.groupBy(by).agg(F.count("*").alias("jobs"), *(n.alias(s) for s, n in counts.items()), F.coalesce(out, F.lit("completed")).alias("batch_state"))


def latest(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """Each group's first row in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def after_cursor(events: DataFrame, sequence: str, cursor: int, n: int) -> DataFrame:
    return events.where(F.col(sequence) > cursor).orderBy(sequence).limit(n)


def fan_out(events: DataFrame) -> DataFrame:
    """Each event and, unless it is one, a snapshot update behind it."""
    snapshot = F.struct(F.lit("snapshot.updated").alias("event_type"), F.lit(1).alias("step"))
    own = F.struct(F.col("event_type"), F.lit(0).alias("step"))
    made = F.when(F.col("event_type") == "snapshot.updated", F.array(own)).otherwise(F.array(own, snapshot))
    return events.withColumn("e", F.explode(made)).select("event_id", "user_id", F.col("e.event_type").alias("event_type"), F.col("e.step").alias("step"))


def streaks(events: DataFrame, by: str, order: str, length: int) -> DataFrame:
    """Runs of at least so many equal event types in a row of each group."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.coalesce(F.lag("event_type").over(w) != F.col("event_type"), F.lit(True))
    rows = events.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "run", "event_type").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last")).where(F.col("n") >= length).drop("run")


class Acceptance:
    """What a stream has accepted: the cursor, and the ids since the last snapshot (any container with in, add and clear)."""

    def __init__(self, cursor: int, seen):
        self.cursor, self.seen = cursor, seen

    def decide(self, event_id: int, sequence: int, fits: bool, snapshot: bool) -> str:
        """A snapshot puts the cursor where it says, back as well as on, and forgets the ids; only accepted events move it else."""
        if snapshot:
            self.cursor = sequence
            self.seen.clear()
            return "snapshot"
        if not fits:
            return "schema_mismatch"
        if event_id in self.seen:
            return "duplicate"
        if sequence <= self.cursor:
            return "out_of_order"
        if 0 < self.cursor < sequence - 1:
            return "sequence_gap"
        self.cursor = sequence
        self.seen.add(event_id)
        return "accepted"


def _decided(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, state = None, Acceptance(0, set())
    for frame in frames:
        decisions = []
        for stream, event_id, sequence, fits, snapshot in zip(frame["stream"], frame["event_id"], frame["sequence"], frame["matches"], frame["snapshot"]):
            if stream != now:
                now, state = stream, Acceptance(0, set())
            decisions.append(state.decide(event_id, sequence, fits, snapshot))
        yield frame.assign(decision=decisions)[["stream", "arrival", "event_id", "sequence", "decision"]]


def accepted(events: DataFrame) -> DataFrame:
    """Decision on each event of a stream (stream, event_id, sequence, arrival, all long; matches where versions are checked,
    snapshot where rows may be snapshots): schema_mismatch, duplicate, out_of_order, sequence_gap, accepted or snapshot.

    Only accepted events and snapshots move the cursor, so the decision needs what was decided before: streams pass through a
    worker one after another, in order of arrival, and it holds the cursor and the ids that one stream has accepted since its
    last snapshot, never its events. The streaming form keeps the same state by key.
    """
    flag = lambda name, default: F.col(name) if name in events.columns else F.lit(default).alias(name)
    rows = events.select("stream", "arrival", "event_id", "sequence", flag("matches", True), flag("snapshot", False))
    dealt = rows.repartition("stream").sortWithinPartitions("stream", "arrival", "event_id")
    return dealt.mapInPandas(_decided, "stream long, arrival long, event_id long, sequence long, decision string")


def within_budget(calls: DataFrame, by: str, order: str, each: int) -> DataFrame:
    """Calls with a grant while their category has budget left: the first ``each`` by ``order``, whose values differ.

    The last value that is granted comes from the ``each`` smallest ones of every task, so no category is sorted in one. Null
    categories are one; rows without an order come first, as in a sort.
    """
    place = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"))
    parts = calls.select(by, place.alias("p"), F.spark_partition_id().alias("part"))
    few = parts.withColumn("n", F.row_number().over(Window.partitionBy(by, "part").orderBy("p"))).where(F.col("n") <= each)
    last = few.groupBy(by).agg(F.element_at(F.slice(F.sort_array(F.collect_list("p")), 1, each), -1).alias("last"))
    last = last.select(F.col(by).alias("_by"), "last")
    return calls.join(last, F.col(by).eqNullSafe(F.col("_by"))).withColumn("granted", place <= F.col("last")).drop("_by", "last")


def picked(rows: DataFrame, by: str, key: str, kinds: dict[str, tuple[Column, Column]]) -> DataFrame:
    """by, kind, key: for each kind in turn the best row of its pool that no kind before has taken, by score and then key, both falling.

    ``kinds`` gives for each its pool, a condition, and its score, an array of numbers. A pick may be any of the best as many rows
    as there are kinds: so many a kind are kept, task by task, in one pass, and picked from in turn. A kind whose pool is
    used up has no row; keys must differ within a group.
    """
    n = len(kinds)
    each = F.array(*(F.struct(F.lit(i).alias("kind"), pool.alias("fit"), score.cast("array<double>").alias("score")) for i, (pool, score) in enumerate(kinds.values())))
    rows = rows.select(by, F.col(key).alias("_key"), F.explode(each).alias("e")).where("e.fit").select(by, "_key", "e.kind", "e.score")
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy(by, "kind").orderBy(F.desc("score"), F.desc("_key")))).where(F.col("n") <= n)
    held = best.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("kind", "n", "_key"))).alias("held"))
    taken = F.array().cast(f"array<struct<kind:int,_key:{dict(rows.dtypes)['_key']}>>")

    def step(a: Column, kind: Column) -> Column:
        free = F.filter("held", lambda h: (h["kind"] == kind) & ~F.exists(a, lambda t: t["_key"] == h["_key"]))
        return F.when(F.size(free) > 0, F.array_append(a, F.struct(kind.alias("kind"), free[0]["_key"].alias("_key")))).otherwise(a)

    out = held.select(by, F.explode(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), taken, step)).alias("t"))
    return out.select(by, F.element_at(F.array(*map(F.lit, kinds)), F.col("t.kind") + 1).alias("kind"), F.col("t._key").alias(key))
