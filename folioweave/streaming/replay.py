"""Event streams: limits, locks, audit and alerts, and replays that run a stream over what is there and account for every row."""

from __future__ import annotations

import datetime
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..session import shared_folder

LOCK, RELEASE, EDIT = "signup", "purchase", "click"
#: The type of the row that closes a replay, later than any event: it moves the watermark past all of them.
END, END_AT = "end of input", datetime.datetime(2200, 1, 1)
LATE = "1 hour"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """New event files as a stream, with zoned timestamps, which watermarks need."""
    schema = spark.read.parquet(path).schema
    # A stream takes a folder or a pattern; the pattern also names a single file.
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def document(user: Column) -> Column:
    """The document of an event: five users share one, so there are more as there are more users."""
    return F.floor(user / 5)


def once_on_time(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event once, without those more than ``late`` behind the newest of the triggers before.

    Rows are judged one by one, before anything gathers them, so Spark's count of dropped rows
    is exact, and what comes after drops none. An id is remembered until the watermark has
    passed it, so state stays bounded.
    """
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def hourly_counts(events: DataFrame) -> DataFrame:
    """hour, user_id, n, once an hour is over."""
    counts = events.groupBy(F.window("ts", "1 hour"), "user_id").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "user_id", "n")


def moving_counts(events: DataFrame, width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    """start, event_type, n of windows of ``width`` that begin every ``step``, once each is over."""
    counts = events.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def daily_counts(events: DataFrame) -> DataFrame:
    """day, event_type, n, once a day is over."""
    counts = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def audit(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") != END).select("event_id", "user_id", "event_type")


def with_dimension(events: DataFrame, customer: DataFrame) -> DataFrame:
    return events.join(customer, events["user_id"] == customer["c_custkey"]).select("event_id", F.col("c_name").alias("owner"))


def alerts(events: DataFrame, orders: DataFrame, least: float = 50) -> DataFrame:
    """event_id, user_id, n_affected of substantial edits (value over ``least``): how many documents depend on the edited one."""
    edges = orders.groupBy("o_custkey").agg(F.count("*").alias("n_affected"))
    edits = events.where((F.col("event_type") == EDIT) & (F.col("value") > least))
    return edits.join(edges, F.col("user_id") == F.col("o_custkey")).select("event_id", "user_id", "n_affected")


def auto_commits(events: DataFrame, gap: str = "2 hours", least: int = 2) -> DataFrame:
    """user_id, start, edits: a session of ``least`` edits or more is committed when no edit follows for ``gap``."""
    edits = events.where(F.col("event_type").isin(EDIT, END))
    found = edits.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("edits"))
    return found.where(F.col("edits") >= least).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "edits")


def requests_met(asked: DataFrame, freed: DataFrame) -> DataFrame:
    """request, release of the same document within the hour: two streams joined, each with a watermark, so neither is remembered for longer."""
    a = asked.where(F.col("event_type").isin(EDIT, END)).select(document(F.col("user_id")).alias("doc"), F.col("event_id").alias("request"), F.col("ts").alias("asked_at"))
    b = freed.where(F.col("event_type").isin(RELEASE, END)).select(document(F.col("user_id")).alias("doc_b"), F.col("event_id").alias("release"), F.col("ts").alias("freed_at"))
    within = F.expr("doc = doc_b AND freed_at >= asked_at AND freed_at <= asked_at + INTERVAL 1 HOUR")
    return a.join(b, within).select("request", "release")


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's events of one trigger; how many there can be is bounded by maxFilesPerTrigger."""
    return pd.concat(list(batches)).sort_values(["ts", "event_id"])


def lock_counts(events: DataFrame) -> DataFrame:
    """user_id, held, acquired, refused: a lock is acquired if free, refused if held, and freed by a release.

    A row for each user and trigger. Events are stepped in the order of time within a
    trigger, and triggers in the order of files.
    """

    def step(key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, acquired, refused = state.get if state.exists else (False, 0, 0)
        for kind in _in_order(batches)["event_type"]:
            if kind == LOCK:
                acquired, refused, held = acquired + (not held), refused + held, True
            else:
                held = False
        now = (bool(held), int(acquired), int(refused))
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["user_id", "held", "acquired", "refused"])

    own = "held boolean, acquired long, refused long"
    return events.where(F.col("event_type").isin(LOCK, RELEASE)).groupBy("user_id").applyInPandasWithState(step, f"user_id long, {own}", own, "update", GroupStateTimeout.NoTimeout)


Lock = tuple[int, int, int]


def lock_step(doc: int, lock: Lock | None, event: tuple[int, int, str, int, float], hours: int, override: float) -> tuple[Lock | None, list[tuple]]:
    """A document's lock (holder, end, event) after an event (microseconds, id, type, user, value), and the outcomes: doc, event, what, user.

    A lock request is granted if the document is free, refused if another holds it, and
    overrides the holder if its value is over ``override`` (an administrator's). Only the
    holder's release frees it. A lock runs out after ``hours``.
    """
    now, number, kind, user, value = event
    out = []
    if lock is not None and now > lock[1]:
        out.append((doc, lock[2], "expired", lock[0]))
        lock = None
    if kind == LOCK:
        if lock is None or value > override:
            out.append((doc, number, "granted" if lock is None else "overridden", user))
            lock = (user, now + hours * 3_600_000_000, number)
        else:
            out.append((doc, number, "refused", user))
    elif kind == RELEASE and lock is not None and lock[0] == user:
        out.append((doc, number, "released", user))
        lock = None
    return lock, out


OUTCOME = "doc long, event_id long, outcome string, holder long"


def _outcomes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc", "event_id", "outcome", "holder"]).astype({"doc": "int64", "event_id": "int64", "holder": "int64"})


def lock_lifecycle(events: DataFrame, documents: int, hours: int = 12, override: float = 200, late: str = LATE) -> DataFrame:
    """doc, event_id, outcome, holder by lock_step(), each as soon as its trigger: events are stepped in the order of time within a trigger.

    A lock runs out at the next event of the document, or when the watermark passes its end and nothing came.
    """

    def step(key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lock, out = state.get if state.exists else None, []
        if state.hasTimedOut:
            out.append((key[0], lock[2], "expired", lock[0]))
            state.remove()
        else:
            for e in _in_order(batches).itertuples():
                lock, outcomes = lock_step(key[0], lock, (e.ts.value // 1000, e.event_id, e.event_type, e.user_id, e.value), hours, override)
                out += outcomes
            if lock is not None:
                state.update(tuple(map(int, lock)))
                state.setTimeoutTimestamp(max(lock[1] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield _outcomes(out)

    marked = events.withWatermark("ts", late).where(F.col("event_type").isin(LOCK, RELEASE)).withColumn("doc", F.col("user_id") % documents)
    return marked.groupBy("doc").applyInPandasWithState(step, OUTCOME, "holder long, until long, lock long", "append", GroupStateTimeout.EventTimeTimeout)


class InOrder(StatefulProcessor):
    """Steps each document's events in the order of time, whatever triggers they came in.

    Events wait in a list until the watermark has passed them, when none before them can come; a
    timer then steps them. What waits is bounded by the events of the watermark's delay. Each call
    to a store is a message to the JVM, so a document's state is read and written once a timer,
    not once an event: load() reads it, step() and passed() change it, and keep() writes it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, event_id long, event_type string, user_id long, value double")
        self.begin(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part[part["event_type"] != END]
            if len(part):
                self.waiting.appendList(list(zip(*(part[c].tolist() for c in ("at", "event_id", "event_type", "user_id", "value")), strict=True)))
                self.handle.registerTimer(int(part["at"].min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(e) for e in self.waiting.get()]
        out, left = [], sorted(e for e in waiting if e[0] > now)
        self.load()
        for e in sorted(e for e in waiting if e[0] <= now):
            out += self.step(key[0], e)
        out += self.passed(key[0], now)
        ends = self.keep()
        if len(left) < len(waiting):
            self.waiting.clear()
            if left:
                self.waiting.put(left)
        soon = min([e[0] for e in left[:1]] + ([] if ends is None else [ends]), default=None)
        if soon is not None:
            self.handle.registerTimer(soon // 1000 + 1)
        if out:
            yield self.frame(out)

    def close(self) -> None:
        pass


class Locks(InOrder):
    """lock_step() in the order of time; a lock that runs out is told when the watermark passes its end."""

    def __init__(self, hours: int, override: float) -> None:
        self.hours, self.override, self.frame = hours, override, _outcomes

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("lock", "holder long, until long, lock long")

    def load(self) -> None:
        found = self.stored.get()
        self.lock = self.before = None if found is None else tuple(found)

    def keep(self) -> int | None:
        if self.lock is None and self.before is not None:
            self.stored.clear()
        elif self.lock != self.before:
            self.stored.update(self.lock)
        return None if self.lock is None else self.lock[1]

    def step(self, doc: int, event: tuple) -> list[tuple]:
        self.lock, out = lock_step(doc, self.lock, event, self.hours, self.override)
        return out

    def passed(self, doc: int, now: int) -> list[tuple]:
        if self.lock is None or self.lock[1] >= now:
            return []
        lock, self.lock = self.lock, None
        return [(doc, lock[2], "expired", lock[0])]


class Queue(InOrder):
    """Requests to join wait for the document's next release, which answers all of them; after ``minutes`` they lapse."""

    def __init__(self, minutes: int) -> None:
        self.most = minutes * 60_000_000

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getListState("asked", "ts long, request long")

    def load(self) -> None:
        self.asked = [tuple(x) for x in self.stored.get()]
        self.before = list(self.asked)

    def keep(self) -> int | None:
        if self.asked != self.before:
            self.stored.clear()
            if self.asked:
                self.stored.put(self.asked)
        return self.asked[0][0] + self.most if self.asked else None

    def step(self, doc: int, event: tuple) -> list[tuple]:
        now, number, kind, *_ = event
        if kind == EDIT:
            self.asked.append((now, number))
            return []
        lapsed = self.passed(doc, now)
        asked, self.asked = self.asked, []
        return lapsed + [(doc, request, number, place) for place, (_, request) in enumerate(asked, 1)]

    def passed(self, doc: int, now: int) -> list[tuple]:
        lapsed = [x for x in self.asked if x[0] + self.most < now]
        self.asked = self.asked[len(lapsed) :]
        return [(doc, request, None, None) for _, request in lapsed]

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc", "request", "release", "place"]).astype({"doc": "int64", "request": "int64", "release": "Int64", "place": "Int64"})


def _stepped(events: DataFrame, kinds: tuple[str, ...], processor: InOrder, schema: str) -> DataFrame:
    kept = events.where(F.col("event_type").isin(*kinds, END)).where(F.col("user_id").isNotNull() | (F.col("event_type") == END))
    named = kept.select(F.coalesce(document(F.col("user_id")), F.lit(-1)).alias("doc"), "event_id", "ts", F.unix_micros("ts").alias("at"), "event_type", F.coalesce("user_id", F.lit(-1)).alias("user_id"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return named.groupBy("doc").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def locks_in_order(events: DataFrame, hours: int = 12, override: float = 200) -> DataFrame:
    """doc, event_id, outcome, holder by lock_step(), the same for any order of files and any triggers but for rows that came too late."""
    return _stepped(events, (LOCK, RELEASE), Locks(hours, override), OUTCOME)


def join_answers(events: DataFrame, minutes: int = 60) -> DataFrame:
    """doc, request, release, place: each request to join with the next release of its document, or null if none came in time, and its place in the queue."""
    return _stepped(events, (EDIT, RELEASE), Queue(minutes), "doc long, request long, release long, place long")


class Hooks:
    """Named hooks over micro-batches: register as many as wanted for an event, and they run in that order."""

    EVENTS = ("onCommit", "onSearch", "onDiff")

    def __init__(self) -> None:
        self.known: dict[str, list[Callable[[DataFrame], None]]] = {e: [] for e in self.EVENTS}

    def register(self, event: str, hook: Callable[[DataFrame], None]) -> None:
        if event not in self.known:
            raise ValueError(f"no such event: {event}")
        self.known[event].append(hook)

    def trigger(self, event: str, data: DataFrame) -> None:
        for hook in self.known[event]:
            hook(data)


def dispatch(stream: DataFrame, hooks: Hooks, route: dict[str, Column]):
    """A writer that triggers hooks on every micro-batch: for each event of ``route`` with the rows that its condition holds for.

    A batch without such rows triggers nothing. Hooks run in the order they were registered in;
    one that fails stops the stream, and its batch is given again after a restart.
    """

    def each(batch: DataFrame, number: int) -> None:
        for event, condition in route.items():
            rows = batch.where(condition)
            if not rows.isEmpty():
                hooks.trigger(event, rows)

    return stream.writeStream.foreachBatch(each)


def run(spark: SparkSession, stream: DataFrame, mode: str, key: str | None = None) -> DataFrame:
    """The rows a stream gives when it has read all that is there, through Parquet in the folder of spark.checkpoint.dir.

    In complete mode those of the last trigger, in update mode those of every trigger, or of each ``key`` its last.
    """
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("trigger", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/rows/{'last' if mode == 'complete' else number}")

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(stream.withColumn("trigger", F.lit(0).cast("long")).schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    if key is not None:
        newest = Window.partitionBy(key).orderBy(F.desc("trigger"))
        rows = rows.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")
    return rows.drop("trigger")


class Replayed(NamedTuple):
    """What a replay gave, and where each row went."""

    rows: DataFrame
    n_input: int  #: rows read
    n_late: int  #: rows dropped for coming too late
    n_repeated: int  #: rows dropped for an id seen before
    n_late_after: int  #: rows, or groups of them, that operators after once_on_time() dropped: none, if the plan is sound
    most_state: int  #: rows of state after a trigger, at most


class _Accounts(StreamingQueryListener):
    """Sums the progress of the runs that are asked for."""

    def __init__(self) -> None:
        self.sums: dict[str, Counter] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def of(self, run: object) -> tuple[Counter, threading.Event]:
        with self.lock:
            return self.sums.setdefault(str(run), Counter()), self.ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event) -> None:
        self.of(event.runId)

    def onQueryProgress(self, event) -> None:
        p, (total, _) = event.progress, self.of(event.progress.runId)
        total["n_input"] += p.numInputRows
        for o in p.stateOperators:
            first = o.operatorName == "dedupeWithinWatermark"
            total["n_late" if first else "n_late_after"] += o.numRowsDroppedByWatermark
            total["n_repeated"] += dict(o.customMetrics).get("numDroppedDuplicateRows", 0) if first else 0
        total["most_state"] = max(total["most_state"], sum(o.numRowsTotal for o in p.stateOperators))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.of(event.runId)[1].set()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replayed(spark: SparkSession, path: str, apply: Callable[..., DataFrame], late: str = LATE, files_per_trigger: int = 4, inputs: int = 1) -> Replayed:
    """Streams a folder of events through ``apply`` to its end, in append mode, and accounts for every row.

    ``apply`` takes once_on_time() of the events, ``inputs`` times. When all are read, a closing row
    later than any event moves the watermark past them, so that open windows, sessions, timers and
    queues end. Rows go to Parquet in the shared folder by the file sink, once each; a restart
    goes on from the checkpoint beside them.
    """
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    values = {"event_id": -1, "ts": END_AT, "event_type": END}
    closing = spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema)
    closing.limit(0).write.parquet(f"{out}/closing")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # transformWithState needs it

    def events() -> DataFrame:
        end = spark.readStream.schema(schema).parquet(f"{out}/closing").withColumn("ts", F.col("ts").cast("timestamp"))
        return once_on_time(event_stream(spark, path, files_per_trigger).unionByName(end), late)

    rows, accounts, total = apply(*[events() for _ in range(inputs)]), _Accounts(), Counter()
    spark.streams.addListener(accounts)
    try:
        for closes in (False, True):
            if closes:
                closing.write.mode("append").parquet(f"{out}/closing")
            q = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
            found, ended = accounts.of(q.runId)
            if not ended.wait(60):
                raise RuntimeError("the query's last progress was not told")
            most = max(total["most_state"], found["most_state"])
            total.update(found)
            total["most_state"] = most
    finally:
        spark.streams.removeListener(accounts)
    read = spark.read.schema(rows.schema).parquet(f"{out}/rows")
    return Replayed(read, total["n_input"] - inputs, *(total[k] for k in ("n_late", "n_repeated", "n_late_after", "most_state")))
