"""Event logs as streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.queue import Acceptance


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    """The event table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events*.parquet")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and values by type and window of event time; later ones than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def _decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    cursor, seen = state.get if state.exists else (0, [])
    own = Acceptance(cursor, set(seen))
    # rows of a micro-batch come in no order of their own
    frame = pd.concat(list(frames)).sort_values("arrival", kind="stable")
    decisions = [own.decide(int(e), int(s), bool(m), False) for e, s, m in zip(frame["event_id"], frame["sequence"], frame["matches"])]
    yield frame.assign(stream=key[0], decision=decisions)[["stream", "event_id", "sequence", "decision"]]
    state.update((own.cursor, [int(x) for x in own.seen]))


def accepted(events: DataFrame) -> DataFrame:
    """Decision on each event of (stream, event_id, sequence, arrival, and matches where versions are checked):
    schema_mismatch, duplicate, out_of_order, sequence_gap or accepted, in order of arrival within a micro-batch.

    State by stream: the cursor, which only accepted events move, and the ids accepted so far.
    """
    if "matches" not in events.columns:
        events = events.withColumn("matches", F.lit(True))
    return events.groupBy("stream").applyInPandasWithState(_decide, "stream long, event_id long, sequence long, decision string", "cursor long, seen array<long>", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows a stream has now: run to its end into a table in the shared folder."""
    spark = stream.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    path = f"{folder}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    else:
        run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows")).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


class _Seen:
    """The ids in a map state; those looked up or set in a call are not asked for again."""

    def __init__(self, state):
        self.state, self.known = state, {}

    def __contains__(self, event_id: int) -> bool:
        event_id = int(event_id)
        if event_id not in self.known:
            self.known[event_id] = self.state.containsKey((event_id,))
        return self.known[event_id]

    def add(self, event_id: int) -> None:
        self.known[int(event_id)] = True
        self.state.updateValue((int(event_id),), (True,))

    def clear(self) -> None:
        for key in [k for (k,) in self.state.keys()]:
            self.state.removeKey((key,))
        # all that is asked for from here on is not there
        self.known = _Nothing()


class _Nothing(dict):
    def __contains__(self, key) -> bool:
        return True

    def __missing__(self, key) -> bool:
        return False


class _Store(StatefulProcessor):
    """A stream's cursor as a value, its accepted ids as a map: an event reads and writes its own entry only."""

    def __init__(self, heartbeat: int):
        self.heartbeat = heartbeat

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "cursor long")
        self.seen = handle.getMapState("seen", "event_id long", "there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.heartbeat and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.heartbeat)
        state = Acceptance(self.cursor.get()[0] if self.cursor.exists() else 0, _Seen(self.seen))
        # rows of a micro-batch come in no order of their own
        frame = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        fields = zip(frame["event_id"], frame["sequence"], frame["matches"], frame["snapshot"])
        frame["decision"] = [state.decide(int(e), int(s), bool(m), bool(r)) for e, s, m, r in fields]
        self.cursor.update((int(state.cursor),))
        yield frame[["stream", "event_id", "sequence", "decision"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.heartbeat)
        cursor = self.cursor.get()[0] if self.cursor.exists() else 0
        yield pd.DataFrame({"stream": [key[0]], "event_id": pd.array([None], "Int64"), "sequence": [cursor], "decision": ["heartbeat"]})

    def close(self) -> None:
        pass


#: What the state store of ``stored`` needs the session to be set to.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stored(events: DataFrame, heartbeat: int = 0) -> DataFrame:
    """As ``accepted``, for events that may be snapshots (a boolean column): one sets the cursor and forgets the ids.

    The ids are entries of a map state, read and written one by one, not a list that is rewritten; a snapshot bounds them. With a
    ``heartbeat`` of so many milliseconds each stream that had events sends a row with its cursor whenever that time has passed.
    The session takes the state store of ``STORE``.
    """
    for name, value in STORE.items():
        events.sparkSession.conf.set(name, value)
    flag = lambda name, default: F.col(name) if name in events.columns else F.lit(default).alias(name)
    rows = events.select("stream", "arrival", "event_id", "sequence", flag("matches", True), flag("snapshot", False))
    mode = "ProcessingTime" if heartbeat else "None"
    return rows.groupBy("stream").transformWithStateInPandas(_Store(heartbeat), "stream long, event_id long, sequence long, decision string", "Append", mode)
