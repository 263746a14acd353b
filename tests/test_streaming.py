"""Streams over several files, late rows and restarts."""

import random
import time
from datetime import datetime, timedelta
from decimal import Decimal as D

import brute
import pytest
from pyspark.sql import functions as F

from tallybook import Ledger
from tallybook.contract.registry import Inputs
from tallybook.contract.stream_cases import in_files
from tallybook.streaming.jobs import admit_stream, match_stream, revenue_stream, throttle_stream
from tallybook.operators.rates import throttle
from tallybook.streaming.order import late_rows
from tallybook.streaming.tables import instant, parquet_stream, run_to_end, wall_time
from tallybook.streaming.windows import running_activity, running_collections, stream_activity, stream_collections

T0 = datetime(2024, 1, 1)
PAYMENT = "student_id long, created_at timestamp_ntz, id long, amount_paid decimal(12,2), payment_method string, payment_date date, collected_by long"


def feed(spark, path, rows, schema):
    """One file per call, in order of arrival."""
    time.sleep(0.02)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return parquet_stream(spark, path, spark.createDataFrame([], schema).schema, 1)


def payment(i, student, minutes, amount):
    ts = T0 + timedelta(minutes=minutes)
    return (student, ts, i, D(amount), "cash", ts.date(), i % 3)


def test_admission_over_many_batches(spark, tmp_path):
    rng = random.Random(2)
    prices = {s: D(rng.choice([50, 300])) for s in range(5)}
    led = Ledger(
        students=spark.createDataFrame([(s, s) for s in prices], "id long, course_id long"),
        courses=spark.createDataFrame([(s, "c", p, True) for s, p in prices.items()], "id long, name string, price decimal(12,2), is_active boolean"),
        payments=spark.createDataFrame([(1, D(10))], "student_id long, amount_paid decimal(12,2)"),
    )
    path, base = str(tmp_path / "in"), str(tmp_path / "job")
    everything, opened, done = [], {**prices, 1: prices[1] - 10}, 0
    for step in range(2):
        for _ in range(3):
            rows = [payment(done + i, rng.randrange(5), rng.randrange(100), rng.randrange(1, 60)) for i in range(20)]
            done += 20
            everything += rows
            feed(spark, path, rows, PAYMENT)
        verdicts = brute.admit([(r[0], (r[1], r[2]), r[3]) for r in everything], opened)
        want = {r[2]: verdicts[r[0], (r[1], r[2])] for r in everything}
        got = admit_stream(stream(spark, path, PAYMENT), led, base, compact=2)  # a restart in the second step
        assert {r.id: r.verdict for r in got.collect()} == want


def test_throttle_does_not_depend_on_the_batches(spark, tmp_path):
    """Events come up to ``late`` out of order; the answer is that of the batch operator."""
    rng = random.Random(4)
    schema, path, base = "k long, ts timestamp_ntz, id long", str(tmp_path / "in"), str(tmp_path / "job")
    gap, late, everything = timedelta(seconds=60), timedelta(seconds=150), []
    for b in range(5):
        rows = [(rng.choice([0, 0, 1, None]), T0 + timedelta(seconds=b * 200 + rng.randrange(-100, 200)), b * 50 + i) for i in range(50)]
        everything += rows
        feed(spark, path, rows, schema)
        if b in (1, 3, 4):  # restarts; what waits is judged provisionally each time
            got = throttle_stream(stream(spark, path, schema), "k", "ts", "id", gap, base, late)
            batch = throttle(spark.createDataFrame(everything, schema), "k", "ts", "id", gap)
            assert {r.id: r.allowed for r in got.collect()} == {r.id: r.allowed for r in batch.collect()}
    assert late_rows(spark, base, spark.createDataFrame([], schema).schema).count() == 0


def test_later_event_of_an_earlier_time(spark, tmp_path):
    """The first event refuses nothing that happened hours before it; what comes too late is kept apart."""
    schema, path, base = "k long, ts timestamp_ntz, id long", str(tmp_path / "in"), str(tmp_path / "job")
    for hour, i in ((2, 1), (0, 2), (9, 3), (1, 4)):
        feed(spark, path, [(1, T0 + timedelta(hours=hour), i)], schema)
    got = throttle_stream(stream(spark, path, schema), "k", "ts", "id", timedelta(seconds=60), base, timedelta(hours=3))
    assert {r.id: r.allowed for r in got.collect()} == {1: True, 2: True, 3: True}
    assert [r.id for r in late_rows(spark, base, spark.createDataFrame([], schema).schema).collect()] == [4]


def test_state_does_not_grow_with_the_batches(spark, tmp_path):
    schema, path, base = "k long, ts timestamp_ntz, id long", str(tmp_path / "in"), tmp_path / "job"
    for b in range(12):
        feed(spark, path, [(i, T0 + timedelta(minutes=10 * b, seconds=i), b * 5 + i) for i in range(5)], schema)
    got = throttle_stream(stream(spark, path, schema), "k", "ts", "id", timedelta(seconds=60), str(base), timedelta(minutes=10))
    assert got.where("allowed").count() == 60
    for name in ("clocks", "waiting", "marks"):
        assert len([f for f in (base / name).iterdir() if f.name.startswith("batch=")]) <= 3, name


def test_sums_keep_only_what_a_rerun_needs(spark, tmp_path):
    path = str(tmp_path / "in")
    for b in range(9):
        feed(spark, path, [payment(b, 1, b, 1)], PAYMENT)
    revenue_stream(stream(spark, path, PAYMENT), str(tmp_path / "job"), compact=2)
    for name, most in (("parts", 4), ("full", 2)):
        assert len([f for f in (tmp_path / "job/sums" / name).iterdir() if f.name.startswith("batch=")]) <= most


def test_validity_over_many_batches(spark, tmp_path):
    rng = random.Random(6)
    schema = "k long, code string, ts timestamp_ntz, id long, supersedes boolean, is_issue boolean"
    path, ttl = str(tmp_path / "in"), timedelta(minutes=10)
    issues, attempts = [], []
    for b in range(3):
        rows = []
        for i in range(60):
            issue = rng.random() < 0.5
            row = (rng.randrange(3), str(rng.randrange(2)), T0 + timedelta(minutes=b * 60 + rng.randrange(60)), b * 60 + i, issue and rng.random() < 0.3)
            rows.append((*row, issue))
            (issues if issue else attempts).append(row if issue else row[:4])
        feed(spark, path, rows, schema)
    got = match_stream(stream(spark, path, schema), ["k"], "code", ttl, str(tmp_path / "job"), timedelta(minutes=70))
    assert {r.id: r.valid for r in got.collect()} == brute.validity(issues, attempts, ttl)


def test_revenue_over_many_batches(spark, tmp_path):
    path, want = str(tmp_path / "in"), {}
    for b in range(7):
        rows = [payment(b * 10 + i, 1, 60 * 24 * (b * 9 + i), 1 + i) for i in range(10)]
        feed(spark, path, rows, PAYMENT)
        for r in rows:
            month = r[5].replace(day=1)
            want[month] = want.get(month, 0) + r[3]
    got = revenue_stream(stream(spark, path, PAYMENT), str(tmp_path / "job"), compact=3)
    assert {r.month_start: r.monthly_total for r in got.collect()} == want
    again = revenue_stream(stream(spark, path, PAYMENT), str(tmp_path / "job"), compact=3)  # nothing new
    assert {r.month_start: r.monthly_total for r in again.collect()} == want


def test_late_rows_are_dropped_and_closed_windows_complete(spark, tmp_path):
    path, day = str(tmp_path / "in"), 60 * 24
    feed(spark, path, [payment(1, 1, 0, 5), payment(2, 1, 10, 7)], PAYMENT)
    feed(spark, path, [payment(3, 1, 5 * day, 1)], PAYMENT)
    feed(spark, path, [payment(5, 1, 5 * day + 5, 2)], PAYMENT)
    feed(spark, path, [payment(4, 1, 20, 100), payment(6, 1, 9 * day, 3)], PAYMENT)  # 4 is days late
    out = run_to_end(stream_collections(stream(spark, path, PAYMENT)), "t", str(tmp_path / "job"))
    got = {r.window_start: (r.total_collected, r.payment_count) for r in out.collect()}
    assert got == {T0: (D(12), 2), T0 + timedelta(days=5): (D(3), 2)}


def test_running_windows_show_what_is_still_open(spark, tmp_path):
    path, day = str(tmp_path / "in"), 60 * 24
    for rows in ([payment(1, 1, 0, 5)], [payment(2, 1, 10, 7), payment(3, 1, day, 1)], [payment(4, 1, day + 5, 2)]):
        feed(spark, path, rows, PAYMENT)
        out = running_collections(stream(spark, path, PAYMENT), path=str(tmp_path / "job"))
        got = {r.window_start: (r.total_collected, r.payment_count) for r in out.collect()}
    assert got == {T0: (D(12), 2), T0 + timedelta(days=1): (D(3), 2)}


def test_activity_windows_exact_and_approximate(spark, tmp_path):
    schema, path = "id long, user_id long, created_at timestamp_ntz", str(tmp_path / "in")
    feed(spark, path, [(i, i % 4, T0 + timedelta(minutes=i)) for i in range(300)], schema)
    a = run_to_end(stream_activity(stream(spark, path, schema)), "t", str(tmp_path / "a"))
    b = run_to_end(stream_activity(stream(spark, path, schema), approximate=True), "t", str(tmp_path / "b"))
    got = {r.window_start: (r.log_count, r.unique_users) for r in a.collect()}
    assert got[T0 + timedelta(hours=1)] == (60, 4)
    assert {r.window_start: r.log_count for r in b.collect()}[T0 + timedelta(hours=1)] == 60


def test_a_part_of_many_files_is_one_batch(spark, tmp_path):
    """A table of several input partitions loses no row to the watermark, also where parts have fewer rows than files."""
    rows = [(i, T0 + timedelta(minutes=i * 7), i % 9, "click", 1.0, "") for i in range(1000)] + [(1000, T0 + timedelta(days=60), 1, "click", 1.0, "")]
    rows = [rows[i * 7 % len(rows)] for i in range(len(rows))]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    for file_rows in (1_000_000, 100):
        events = in_files(Inputs(spark, str(tmp_path)), "events", "ts", file_rows=file_rows)
        logs = events.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"))
        got = running_activity(logs, late="2 hours", path=str(tmp_path / str(file_rows)))
        want = activity([(r[0], r[2], r[1]) for r in rows], 3600, 300)
        assert {r.window_start: (r.log_count, r.unique_users) for r in got.collect()} == want


ACTIVITY = "id long, user_id long, created_at timestamp_ntz"


def activity(rows, size, slide):
    """window_start -> entries and distinct users; times and lengths in seconds."""
    found = {}
    for _, user, at in rows:
        seconds = int((at - T0).total_seconds())
        start = seconds - seconds % slide
        while start > seconds - size:
            found.setdefault(T0 + timedelta(seconds=start), []).append(user)
            start -= slide
    return {w: (len(users), len(set(users) - {None})) for w, users in found.items()}


@pytest.mark.parametrize("size, slide", [(3600, 300), (420, 180), (600, 600)])
def test_activity_over_many_batches(spark, tmp_path, size, slide):
    """Users that come again in a pane, in a window, in a later batch; users that are null; windows that the slide does not divide."""
    rng = random.Random(size)
    path, everything = str(tmp_path / "in"), []
    for b in range(3):
        rows = [(b * 200 + i, rng.choice([None, *range(9)]), T0 + timedelta(seconds=b * 3000 + rng.randrange(3600))) for i in range(200)]
        rows.append((-b, None, None))
        everything += rows
        feed(spark, path, rows, ACTIVITY)
    want = activity([r for r in everything if r[2]], size, slide)
    windows = {"size": f"{size} seconds", "slide": f"{slide} seconds", "late": "1 hour"}
    now = running_activity(stream(spark, path, ACTIVITY), path=str(tmp_path / "now"), **windows)
    assert {r.window_start: (r.log_count, r.unique_users) for r in now.collect()} == want
    out = run_to_end(stream_activity(stream(spark, path, ACTIVITY), **windows), "t", str(tmp_path / "out"))
    passed = max(r[2] for r in everything if r[2]) - timedelta(hours=1)
    closed = {w: n for w, n in want.items() if w + timedelta(seconds=size) <= passed}
    assert {r.window_start: (r.log_count, r.unique_users) for r in out.collect()} == closed


def test_closed_activity_keeps_no_state_per_user(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "job")
    feed(spark, path, [(i, i, T0) for i in range(2000)], ACTIVITY)
    run_to_end(stream_activity(stream(spark, path, ACTIVITY)), "t", base)
    assert 12 <= spark.read.format("statestore").option("operatorId", 1).load(f"{base}/progress").count() <= 12 * 32


def test_running_activity_keeps_one_row_per_user_and_pane(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "job")
    feed(spark, path, [(i, i % 50, T0 + timedelta(seconds=i % 600)) for i in range(2000)], ACTIVITY)
    running_activity(stream(spark, path, ACTIVITY), path=base)
    assert spark.read.parquet(f"{base}/changed").count() <= 50 * 2


def test_times_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30),)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = df.select("t", wall_time(F.window(instant(F.col("t")), "1 hour")["start"]).alias("w")).first()
        assert row.w == datetime(2024, 3, 10, 2, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
