"""Sequential operators against row-by-row versions, on ordinary and hot keys."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import brute
import pytest
from pyspark.sql import functions as F

from tallybook import Ledger
from tallybook.operators.admission import admit_payments, split_admitted
from tallybook.operators.rates import match_within_validity, throttle
from tallybook.operators.validation import first_come
from tallybook.plans.ordered import Running, running_values

T0 = datetime(2024, 1, 1)


def hot_biased(rng, n_keys):
    """A third of the rows on key 0."""
    return 0 if rng.random() < 0.34 else rng.randrange(n_keys)


@pytest.mark.parametrize("hot_rows,blocks", [(10**6, None), (5, 3), (0, 7), (20, 16)])
def test_running_values(spark, hot_rows, blocks):
    rng = random.Random(1)
    rows = [(hot_biased(rng, 9), rng.randrange(40), i, rng.choice([None, rng.randrange(100)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, t long, id long, v long")
    got = running_values(
        df,
        ["k"],
        [F.col("t").asc(), F.col("id").asc()],
        [Running("n", "count"), Running("s", "sum", F.col("v")), Running("m", "max", F.struct("v", "id")), Running("all", "sum", F.col("v"), whole=True)],
        hot_rows,
        blocks,
    ).collect()
    seen = {}
    want = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        n, s, m = seen.get(k, (0, None, None))
        n += 1
        s = s if v is None else (s or 0) + v
        here = (-1 if v is None else v, i)
        m = here if m is None else max(m, here)
        seen[k] = (n, s, m)
        want[i] = (n, s, m)
    assert len(got) == len(rows)
    for r in got:
        m = (-1 if r.m.v is None else r.m.v, r.m.id)
        assert r.all == (seen[r.k][1])
        assert (r.n, r.s if r.s is not None else None, m) == want[r.id]


def ledger_for(spark, prices):
    students = spark.createDataFrame(
        [(s, s if p is not None else None) for s, p in prices.items()], "id long, course_id long"
    )
    courses = spark.createDataFrame(
        [(s, "c", p, True) for s, p in prices.items() if p is not None],
        "id long, name string, price decimal(12,2), is_active boolean",
    )
    paid = spark.createDataFrame([], "student_id long, amount_paid decimal(12,2), created_at timestamp_ntz, id long")
    return Ledger(users=None, courses=courses, students=students, payments=paid, logs=None)


@pytest.mark.parametrize("fold_rows,blocks", [(10**6, None), (3, 4), (0, 9)])
@pytest.mark.parametrize("seed", range(3))
def test_admission(spark, fold_rows, blocks, seed):
    rng = random.Random(seed)
    prices = {s: Decimal(rng.choice([0, 1, 50, 100, 977, 5000])) for s in range(6)}
    scale = [1, 3, 10, 100, 1000]
    rows = [
        (hot_biased(rng, 6), T0 + timedelta(hours=rng.randrange(60)), i, Decimal(rng.randrange(1, 100)) * rng.choice(scale) / 100)
        for i in range(300)
    ]
    incoming = spark.createDataFrame(
        [(*r, "cash") for r in rows],
        "student_id long, created_at timestamp_ntz, id long, amount_paid decimal(12,2), payment_method string",
    )
    got = admit_payments(incoming, ledger_for(spark, prices), fold_rows=fold_rows, blocks=blocks).collect()
    want = brute.admit([(s, (t, i), a) for s, t, i, a in rows], prices)
    assert {(r.student_id, (r.created_at, r.id)): r.verdict for r in got} == want
    assert len(got) == len(rows)


def test_admission_alternating_large_and_small(spark):
    """Rows that are refused one after another, with small ones between them."""
    amounts = [Decimal(a) for k in range(60) for a in (1, 100 - k)] + [Decimal("0.01")] * 3
    rows = [(1, T0 + timedelta(minutes=i), i, a) for i, a in enumerate(amounts)]
    incoming = spark.createDataFrame(
        [(*r, "cash") for r in rows],
        "student_id long, created_at timestamp_ntz, id long, amount_paid decimal(12,2), payment_method string",
    )
    prices = {1: Decimal(100)}
    got = admit_payments(incoming, ledger_for(spark, prices), fold_rows=1, blocks=5).collect()
    want = brute.admit([(s, (t, i), a) for s, t, i, a in rows], prices)
    assert {(r.student_id, (r.created_at, r.id)): r.verdict for r in got} == want


def test_admission_first_failing_check(spark):
    rows = [
        (1, 1, "10.00", "cash"),  # accepted
        (1, 2, "x", "cash"),
        (1, 3, "-1", "cash"),
        (1, 4, None, "cash"),
        (1, 5, "5", ""),
        (9, 6, "5", "cash"),
        (2, 7, "5", "cash"),  # no price
        (3, 8, "5", "cash"),  # price 0
        (1, 9, "91", "cash"),
        (1, 10, "90", "cash"),
        (1, 11, "1", "cash"),
    ]
    incoming = spark.createDataFrame(rows, "student_id long, id long, amount_paid string, payment_method string")
    led = ledger_for(spark, {1: Decimal(100), 2: None, 3: Decimal(0)})
    judged = admit_payments(incoming, led, order=("id",))
    assert {r.id: r.verdict for r in judged.collect()} == {
        1: "accepted", 2: "invalid_amount", 3: "invalid_amount", 4: "missing_field", 5: "missing_field",
        6: "unknown_student", 7: "no_price", 8: "already_paid", 9: "exceeds_balance", 10: "accepted", 11: "already_paid",
    }
    ok, refused = split_admitted(judged)
    assert ok.count() == 2 and refused.count() == 9


@pytest.mark.parametrize("fold_rows,blocks,fan_in", [(10**6, None, 8), (3, 4, 2), (0, 13, 2), (0, 16, 3)])
@pytest.mark.parametrize("spread", [300, 3000, 60000])
def test_throttle(spark, fold_rows, blocks, fan_in, spread):
    rng = random.Random(spread)
    rows = [(hot_biased(rng, 7), T0 + timedelta(seconds=rng.randrange(spread)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, id long")
    gap = timedelta(seconds=60)
    got = throttle(df, "k", "ts", "id", gap, fold_rows, blocks, fan_in).collect()
    assert {r.id: r.allowed for r in got} == brute.throttle(rows, gap)
    assert len(got) == len(rows)


def test_throttle_exact_gap_and_refused_event(spark):
    at = [0, 59, 60, 119, 120, 120, 185]
    df = spark.createDataFrame([("a", T0 + timedelta(seconds=s), i) for i, s in enumerate(at)], "k string, ts timestamp_ntz, id long")
    got = throttle(df, "k", "ts", "id").orderBy("id").collect()
    assert [r.allowed for r in got] == [True, False, True, False, True, False, True]


@pytest.mark.parametrize("hot_rows,blocks", [(10**6, None), (4, 5)])
@pytest.mark.parametrize("code", [None, "code"])
def test_validity(spark, hot_rows, blocks, code):
    rng = random.Random(3)
    issues, attempts = [], []
    for i in range(300):
        key, c, ts = hot_biased(rng, 5), str(rng.randrange(2)) if code else None, T0 + timedelta(minutes=rng.randrange(200))
        if rng.random() < 0.5:
            issues.append((key, c, ts, i, rng.random() < 0.3))
        else:
            attempts.append((key, c, ts, i))
    ttl = timedelta(minutes=10)
    shape = "k long, code string, ts timestamp_ntz, id long"
    got = match_within_validity(
        spark.createDataFrame(issues, shape + ", supersedes boolean"),
        spark.createDataFrame(attempts, shape),
        ["k"], code, ttl, hot_rows, blocks,
    ).collect()
    assert {r.id: r.valid for r in got} == brute.validity(issues, attempts, ttl)


def test_first_come_with_chains(spark):
    rng = random.Random(5)
    rows = [(i, f"n{rng.randrange(60)}", f"m{rng.randrange(60)}") for i in range(120)]
    rows += [(200 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(12)]  # each refused row frees the next
    rows += [(300 + i, "hot", f"h{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, number string, mail string")
    got = {r.seq for r in first_come(df, "seq", ["number", "mail"]).collect()}
    assert got == brute.first_come(rows)
