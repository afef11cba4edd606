"""Sessions and requests as streams with state (S13 with R3 and R6).

``session_subjects``: the subject in force at every turn. State is kept for runs of
``block`` turns of a session, so one very long session is the work of many tasks; the step
from run to run is a join of one row a run (``with_session_subject``) over what the stream has written.

``first_attempts``: the first attempt of every request, once. Attempts are cut to the
least of each Arrow batch before the shuffle, so a request of very many is no hot spot.

Both take rows in any order and any split into micro-batches: a row waits until the watermark
(``delay`` behind the newest event time) has passed it. The table written equals the batch result,
restarts included, as long as rows are no later than ``delay`` and a session's (request's) event times do
not fall as its turns (attempts) rise. Later rows are not dropped but written at once, with ``late`` true.

Defined results: a row without turn, attempt or time is written at once as late; null sessions and
requests are keys like others; equal turns stand in order of time, then subject; of equal attempts
the least (time, row as JSON) is the first. ``closing`` gives the row whose time is past
every watermark: appended to a source it settles all that waits, and is itself never written.

The state needs the RocksDB store: build streams on ``state_session(spark)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quire.operators.routing import CARRY_BLOCK

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSING_TIME = "9000-01-01 00:00:00"
#: Only changes go to the checkpoint at each batch, few versions stay, and the local
#: copies of a query that has ended are removed soon (each partition has one).
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    "spark.sql.streaming.minBatchesToRetain": "2",
}
KEPT = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")
DAY_MS = 86_400_000


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB; the caller's
    own settings are not touched."""
    own = spark.newSession()
    for name in KEPT:
        own.conf.set(name, spark.conf.get(name))
    for name, value in STATE.items():
        own.conf.set(name, value)
    return own


def closing(rows: DataFrame, time: str = "at") -> DataFrame:
    """One row of the columns of ``rows``, all null but its time."""
    cells = [(F.lit(CLOSING_TIME) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]
    return rows.sparkSession.range(1).select(*cells)


def _timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermarked rows with their time in milliseconds as ``at_ms``. The time itself goes no further: Spark
    would drop late rows by it unseen."""
    open_ = ~F.coalesce(F.col(time) == F.lit(CLOSING_TIME).cast("timestamp"), F.lit(False))
    timed = stream.withWatermark(time, delay).where(open_)
    return timed.withColumn("at_ms", F.unix_millis(F.col(time))).drop(time)


class _Subjects(StatefulProcessor):
    """Turns of one run wait for the watermark, then take the last subject of the run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_ms bigint, turn bigint, subject string")
        self.last = handle.getValueState("last", "turn bigint, subject string")
        self.due = handle.getValueState("due", "at_ms bigint")

    def _rows(self, key, found: list) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(*key, *x) for x in found], columns=["k", "turn", "subject", "run_subject", "late"]).astype(object)

    def _wake(self, at: int | None) -> None:
        old = self.due.get()[0] if self.due.exists() else None
        if at is None:
            self.due.clear()
        elif old is None or at < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        passed, least = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            wait, late = [], []
            frame = frame.astype(object).where(frame.notna(), None)
            for at, turn, subject in zip(frame["at_ms"], frame["turn"], frame["subject"], strict=True):
                if at is None or turn is None or at <= passed:
                    last = self.last.get() if self.last.exists() else None
                    known = last[1] if last is not None and turn is not None and last[0] <= turn else None
                    late.append((turn, subject, known if subject is None else subject, True))
                else:
                    wait.append((int(at), int(turn), subject))
            if wait:
                self.waiting.appendList(wait)
                least = min(x[0] for x in wait) if least is None else min(least, min(x[0] for x in wait))
            yield from self._rows(key, late)
        if least is not None:
            self._wake(least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(((x[0], x[1], x[2]) for x in self.waiting.get()), key=lambda x: (x[0], x[1], x[2] is not None, x[2] or ""))
        stay = [x for x in held if x[0] > passed]
        now = self.last.get()[1] if self.last.exists() else None
        found, named = [], None
        for at, turn, subject in held[: len(held) - len(stay)]:
            if subject is not None:
                now, named = subject, turn
            found.append((turn, subject, now, False))
        if named is not None:
            self.last.update((named, now))
        self.waiting.put(stay) if stay else self.waiting.clear()
        self.due.clear()
        if stay:
            self._wake(stay[0][0])
        yield from self._rows(key, found)


def session_subjects(stream: DataFrame, session: str = "session_id", order: str = "turn", subject: str = "subject", time: str = "at",
                     delay: str = "1 hour", block: int = CARRY_BLOCK) -> DataFrame:
    """A stream of (session, run, turn, subject, run_subject, late): ``run_subject`` is the last subject named
    in the turn's run of ``block`` turns. Only these columns enter the state, never texts."""
    kind = stream.schema[session].dataType.simpleString()
    # a key is one string: a null among numbers would reach the state as a float
    run = F.floor(F.col(order) / block).alias("run")
    rows = _timed(stream.select(F.to_json(F.struct(F.col(session).alias("v"), run)).alias("k"), F.col(order).cast("bigint").alias("turn"),
                                F.col(subject).cast("string").alias("subject"), F.col(time).alias("at")), "at", delay)
    schema = "k string, turn bigint, subject string, run_subject string, late boolean"
    out = rows.groupBy("k").transformWithStateInPandas(_Subjects(), schema, "append", "EventTime").withColumn("key", F.from_json("k", f"v {kind}, run bigint"))
    return out.select(F.col("key.v").alias(session), "key.run", F.col("turn").alias(order), F.col("subject").alias(subject), "run_subject", "late")


def with_session_subject(written: DataFrame, session: str = "session_id", order: str = "turn", subject: str = "subject") -> DataFrame:
    """``session_subject`` of what ``session_subjects`` has written: the run's own subject, else the last one of
    the runs before it. One row a run is windowed, never a whole session's turns."""
    runs = written.groupBy(session, "run").agg(F.max_by(subject, F.when(F.col(subject).isNotNull(), F.col(order))).alias("__last"))
    before = Window.partitionBy(session).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    into = runs.select(F.col(session).alias("__s"), F.col("run").alias("__r"), F.last("__last", ignorenulls=True).over(before).alias("__in"))
    same = F.col(session).eqNullSafe(F.col("__s")) & (F.col("run") == F.col("__r"))
    out = written.join(into, same, "left")
    return out.withColumn("session_subject", F.coalesce("run_subject", "__in")).drop("__s", "__r", "__in")


class _First(StatefulProcessor):
    """The least attempt of one request waits for the watermark; one that went out leaves a mark for ``keep_ms``."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "attempt bigint, at_ms bigint, body string")
        self.sent = handle.getValueState("sent", "until_ms bigint")

    def _send(self, attempt, at: int, body: str, late: bool) -> Iterator[pd.DataFrame]:
        until = at + self.keep_ms
        self.sent.update((until,))
        self.handle.registerTimer(until)
        yield pd.DataFrame({"body": [body], "late": [late]})

    def handleInputRows(self, key, rows, timerValues):
        passed, best = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            frame = frame.astype(object).where(frame.notna(), None)
            for x in zip(frame["attempt"], frame["at_ms"], frame["body"], strict=True):
                if x[0] is None or x[1] is None:
                    yield pd.DataFrame({"body": [x[2]], "late": [True]})
                elif best is None or x < best:
                    best = x
        if best is None or self.sent.exists():
            return
        best = (int(best[0]), int(best[1]), best[2])
        old = self.first.get() if self.first.exists() else None
        if old is not None and tuple(old) <= best:
            return
        if old is not None:
            self.handle.deleteTimer(old[1])
            self.first.clear()
        if best[1] <= passed:
            yield from self._send(*best, True)
        else:
            self.first.update(best)
            self.handle.registerTimer(best[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.first.exists():
            attempt, at, body = self.first.get()
            self.first.clear()
            yield from self._send(attempt, at, body, False)
        elif self.sent.exists():
            self.sent.clear()


def _least_of_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        placed = frame["attempt"].notna() & frame["at_ms"].notna()
        least = frame[placed].sort_values(["attempt", "at_ms", "body"]).drop_duplicates("k")
        yield pd.concat([least, frame[~placed]]) if not placed.all() else least


def first_attempts(stream: DataFrame, request: str = "request_id", order: str = "attempt", time: str = "at", delay: str = "1 hour",
                   keep_ms: int = 7 * DAY_MS) -> DataFrame:
    """A stream of the first attempt's whole row for every request, with ``late``. Further attempts of a request
    are refused until ``keep_ms`` of event time after it."""
    kept = [f for f in stream.schema if f.name != "late"]
    packed = stream.select(F.to_json(F.struct(F.col(request).alias("v"))).alias("k"), F.col(order).cast("bigint").alias("attempt"), F.col(time).alias("at"),
                           F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in kept])).alias("body"))
    rows = _timed(packed, "at", delay)
    rows = rows.mapInPandas(_least_of_batch, rows.schema)
    out = rows.groupBy("k").transformWithStateInPandas(_First(keep_ms), "body string, late boolean", "append", "EventTime")
    schema = type(stream.schema)(kept)
    return out.select(F.from_json("body", schema).alias("x"), "late").select("x.*", "late")


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take what is there and not yet read, append the settled rows to a Parquet table exactly once, and stop."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
