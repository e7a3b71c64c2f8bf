"""Streams of shuffled files: every row is kept, late or repeated, and stateful steps equal machines stepped by hand."""

import datetime
import random
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

from folioweave.streaming import replay

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
START = datetime.datetime(2026, 1, 1)


@pytest.fixture(autouse=True)
def few_state_stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def events(n=400, seed=4, users=12):
    r, at, rows = random.Random(seed), START, []
    for k in range(n):
        at += datetime.timedelta(seconds=r.choice([60, 600, 7200]) + r.random())
        rows.append((k, at, r.randrange(users), r.choice(["signup", "signup", "purchase", "click", "click", "view"]), float(r.choice([1, 1, 1, 500]))))
    return rows


def written(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return folder


def dealt(rows, files):
    return [rows[k::files] for k in range(files)]


@pytest.mark.parametrize(("files", "per_trigger"), [(1, 4), (6, 2)])
def test_every_row_is_accounted_for(spark, tmp_path, files, per_trigger):
    rows = events() + events()[:25]
    shuffled = random.Random(1).sample(rows, len(rows))
    got = replay.replayed(spark, written(spark, str(tmp_path / "e"), dealt(shuffled, files)), replay.audit, files_per_trigger=per_trigger)
    kept = got.rows.count()
    assert got.n_input == len(rows) and kept + got.n_late + got.n_repeated == len(rows)
    assert kept == got.rows.select("event_id").distinct().count() and got.n_late_after == 0
    # The watermark that judges a trigger's rows is that of two triggers before.
    assert (got.n_late > 0) == (files > 2 * per_trigger) and (got.n_late > 0 or got.n_repeated == 25)


def test_windows_hold_what_came_in_time_and_state_is_bounded(spark, tmp_path):
    rows = events(900)
    ordered = written(spark, str(tmp_path / "e"), [rows[k : k + 150] for k in range(0, 900, 150)])
    shuffled = written(spark, str(tmp_path / "s"), dealt(random.Random(2).sample(rows, 900), 4))
    for path, apply, times in ((ordered, replay.hourly_counts, 1), (shuffled, replay.daily_counts, 1), (shuffled, replay.moving_counts, 4)):
        got = replay.replayed(spark, path, apply, late="3 hours", files_per_trigger=1)
        assert got.rows.agg(F.sum("n")).first()[0] == times * (900 - got.n_late) and got.n_late_after == 0
        assert (got.n_late > 0) == (path == shuffled)
        assert path == shuffled or got.most_state < 700  # ids and windows of a trigger and three hours, twice; all would be 1,800


def locks(rows, hours=12, override=200):
    held, out = {}, set()
    for k, ts, user, kind, value in rows:
        doc = user // 5
        if kind not in ("signup", "purchase"):
            continue
        if doc in held and ts > held[doc][1]:
            out.add((doc, held[doc][2], "expired", held.pop(doc)[0]))
        if kind == "signup":
            if doc not in held or value > override:
                out.add((doc, k, "overridden" if doc in held else "granted", user))
                held[doc] = (user, ts + datetime.timedelta(hours=hours), k)
            else:
                out.add((doc, k, "refused", user))
        elif doc in held and held[doc][0] == user:
            out.add((doc, k, "released", user))
            del held[doc]
    return out | {(d, k, "expired", u) for d, (u, _, k) in held.items()}


def answers(rows, minutes=60):
    asked, out = {}, set()
    for k, ts, user, kind, _ in rows:
        doc = user // 5
        if kind == "click":
            asked.setdefault(doc, []).append((ts, k))
        elif kind == "purchase":
            met = [(at, q) for at, q in asked.pop(doc, []) if ts <= at + datetime.timedelta(minutes=minutes) or out.add((doc, q, None, None))]
            out |= {(doc, q, k, n) for n, (_, q) in enumerate(met, 1)}
    return out | {(d, q, None, None) for d, waiting in asked.items() for _, q in waiting}


@pytest.mark.parametrize(("files", "per_trigger", "late"), [(3, 1, "1 hour"), (4, 2, "60 days")])
def test_locks_and_queues_equal_machines_stepped_by_hand(spark, tmp_path, files, per_trigger, late):
    rows = events()
    shuffled = late != "1 hour"  # a delay longer than the table keeps every order of files in time
    parts = dealt(random.Random(3).sample(rows, len(rows)), files) if shuffled else [rows[k * len(rows) // files : (k + 1) * len(rows) // files] for k in range(files)]
    path = written(spark, str(tmp_path / "e"), parts)
    got = replay.replayed(spark, path, replay.locks_in_order, late=late, files_per_trigger=per_trigger)
    assert got.n_late == 0 and {tuple(x) for x in got.rows.collect()} == locks(rows)
    assert {x[2] for x in locks(rows)} == {"granted", "refused", "released", "expired", "overridden"}
    asked = replay.replayed(spark, path, replay.join_answers, late=late, files_per_trigger=per_trigger)
    assert {tuple(x) for x in asked.rows.collect()} == answers(rows)


def test_late_rows_leave_the_machine_of_the_others(spark, tmp_path):
    rows = events()
    path = written(spark, str(tmp_path / "e"), dealt(random.Random(6).sample(rows, len(rows)), 4))
    kept = {x["event_id"] for x in replay.replayed(spark, path, replay.audit, files_per_trigger=1).rows.collect()}
    got = replay.replayed(spark, path, replay.locks_in_order, files_per_trigger=1)
    assert len(kept) + got.n_late == len(rows) and got.n_late > 0
    assert {tuple(x) for x in got.rows.collect()} == locks([x for x in rows if x[0] in kept])


def test_an_empty_folder_gives_nothing(spark, tmp_path):
    got = replay.replayed(spark, written(spark, str(tmp_path / "e"), [[]]), replay.hourly_counts)
    assert (got.rows.count(), got.n_input, got.n_late) == (0, 0, 0)


@pytest.mark.parametrize("make", [lambda: replay.Locks(12, 200), lambda: replay.Queue(60)])
def test_state_is_called_once_a_timer_not_once_an_event(make):
    rows = [(k * 60_000_000, k, ("signup", "click", "purchase")[k % 7 % 3], k % 5, 1.0) for k in range(200)]
    handle, own, waiting, now = MagicMock(), MagicMock(), MagicMock(), MagicMock()
    handle.getListState.side_effect = lambda name, _: waiting if name == "waiting" else own
    handle.getValueState.return_value = own
    waiting.get.return_value, own.get.return_value, own.exists.return_value = rows, [] if isinstance(make(), replay.Queue) else None, False
    now.getCurrentWatermarkInMs.return_value = 10**12
    machine = make()
    machine.init(handle)
    assert sum(len(x) for x in machine.handleExpiredTimer((0,), now, None)) > 0
    assert len(own.method_calls) <= 3 and handle.registerTimer.call_count <= 1
