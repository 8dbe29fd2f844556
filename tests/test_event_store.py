"""Acceptance of events with snapshots, at rest and as a stream of several batches, against plain Python."""

from __future__ import annotations

import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from quire.operators import queue
from quire.streaming import events as streams

SCHEMA = "stream long, arrival long, event_id long, sequence long, matches boolean, snapshot boolean"


def made(n=600, seed=5):
    chance = random.Random(seed)
    return [(chance.randrange(4), i, chance.randrange(60), chance.randrange(1, 8 + i // 20), chance.random() < 0.9, chance.random() < 0.05) for i in range(n)]


def plain(rows):
    cursor, seen, out = defaultdict(int), defaultdict(set), []
    for stream, _, event_id, sequence, matches, snapshot in sorted(rows, key=lambda r: r[1]):
        if snapshot:
            cursor[stream], seen[stream], decision = sequence, set(), "snapshot"
        elif not matches:
            decision = "schema_mismatch"
        elif event_id in seen[stream]:
            decision = "duplicate"
        elif sequence <= cursor[stream]:
            decision = "out_of_order"
        elif cursor[stream] and sequence > cursor[stream] + 1:
            decision = "sequence_gap"
        else:
            cursor[stream], decision = sequence, "accepted"
            seen[stream].add(event_id)
        out.append((stream, event_id, sequence, decision))
    return sorted(out)


def test_batch_and_stream_agree(spark, tmp_path):
    rows = made()
    want = plain(rows)
    assert {d for *_, d in want} == {"snapshot", "schema_mismatch", "duplicate", "out_of_order", "sequence_gap", "accepted"}
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, queue.accepted(table.repartition(3)).drop("arrival").collect())) == want
    for k in range(6):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, streams.drained(streams.stored(stream)).collect())) == want


def test_streams_without_snapshots_or_versions(spark):
    rows = [(1, 1, 7, 1), (1, 2, 7, 2), (1, 3, 8, 2), (1, 4, 9, 4), (2, 1, 7, 5)]
    got = queue.accepted(spark.createDataFrame(rows, "stream long, arrival long, event_id long, sequence long")).collect()
    assert sorted((r.stream, r.arrival, r.decision) for r in got) == [(1, 1, "accepted"), (1, 2, "duplicate"), (1, 3, "accepted"), (1, 4, "sequence_gap"), (2, 1, "accepted")]


def test_heartbeats_carry_the_cursor(spark, tmp_path):
    spark.createDataFrame([(3, 1, 1, 1, True, False), (3, 2, 2, 2, True, False)], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = streams.stored(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), heartbeat=300)
    run = stream.writeStream.format("memory").queryName("beats").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and not spark.table("beats").where("decision = 'heartbeat'").count():
            time.sleep(0.3)
        beats = spark.table("beats").where("decision = 'heartbeat'").collect()
        assert beats and all((r.stream, r.event_id, r.sequence) == (3, None, 2) for r in beats)
    finally:
        run.stop()


def test_budget_is_that_of_a_sort(spark):
    rows = [(k, i) for k in (None, "a", "b") for i in range(30 if k == "a" else 4)]
    got = queue.within_budget(spark.createDataFrame(rows, "kind string, at long").repartition(5), "kind", "at", 10).collect()
    assert len(got) == len(rows) and all(r.granted == (r["at"] < 10) for r in got)
    assert queue.within_budget(spark.createDataFrame(rows, "kind string, at long").where(F.lit(False)), "kind", "at", 10).count() == 0
