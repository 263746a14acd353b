"""Verdicts do not depend on how many rows a key has; results are whole."""

import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import brute
import pytest
from pyspark.sql import functions as F

from tallybook import Ledger
from tallybook.operators.admission import admit_against
from tallybook.operators.guards import cascade_deletes
from tallybook.operators.master import upsert_master
from tallybook.operators.paging import paginate_keyset
from tallybook.operators.rates import match_within_validity, throttle

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("gap", [0, 7])
def test_throttle_ways_agree(spark, kind, gap):
    rng = random.Random(gap)
    rows = [(rng.choice([1, 1, 2, None]), i, rng.choice([None, T0 + timedelta(seconds=rng.randrange(120)), datetime(2500, 1, 1, 0, 0, rng.randrange(60))])) for i in range(200)]
    events = spark.createDataFrame(rows, f"k long, id long, ts {kind}")
    cold = {r.id: r.allowed for r in throttle(events, "k", "ts", "id", timedelta(seconds=gap)).collect()}
    hot = throttle(events, "k", "ts", "id", timedelta(seconds=gap), fold_rows=3, blocks=5, fan_in=2)
    assert {r.id: r.allowed for r in hot.collect()} == cold
    assert all(cold[i] for _, i, ts in rows if ts is None)
    assert gap or all(cold.values())


def test_amounts_are_compared_as_given(spark):
    accounts = spark.createDataFrame([(1, D("100.00")), (2, D("0.00"))], "student_id long, open decimal(22,2)")
    given = ["100.004", "0.004", "1e30", "9" * 25, "-0.001", "abc", None, "60.00", "40.004", "40.00", "0.01"]
    rows = [(1, i, a, "cash") for i, a in enumerate(given)] + [(2, 50, "1", "cash"), (9, 51, "1", "cash"), (None, 52, "1", "cash"), (None, 53, "", "cash")]
    incoming = spark.createDataFrame(rows, "student_id long, id long, amount_paid string, payment_method string")
    want = dict(enumerate(["exceeds_balance", "accepted", "exceeds_balance", "exceeds_balance", "invalid_amount", "invalid_amount", "missing_field", "accepted", "exceeds_balance", "accepted", "already_paid"]))
    want |= {50: "already_paid", 51: "unknown_student", 52: "unknown_student", 53: "missing_field"}
    for fold_rows in (1000, 1):
        got = admit_against(incoming, accounts, ("id",), fold_rows, 3)
        assert {r.id: r.verdict for r in got.collect()} == want


def test_admission_ways_agree(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, str(rng.choice([0, 5, 17.5, 80, 33.333, "x"])), rng.choice(["cash", ""])) for i in range(300)]
    incoming = spark.createDataFrame(rows, "student_id long, id long, amount_paid string, payment_method string")
    accounts = spark.createDataFrame([(1, D(1000)), (2, D(90)), (3, None)], "student_id long, open decimal(22,2)")
    one, other = (
        {r.id: r.verdict for r in admit_against(incoming, accounts, ("id",), n, 4).collect()} for n in (10_000, 10)
    )
    assert one == other and len(one) == 300


def test_upsert_ways_agree(spark):
    rng = random.Random(2)
    acts = ["insert", "update", "activate", "deactivate", "toggle", "toggle"]
    rows = [(i, rng.choice(acts), rng.choice([1, 1, 2, 3, 4]), rng.choice([None, f"n{i}"])) for i in range(120)]
    changes = spark.createDataFrame(rows, "seq long, action string, id long, name string")
    current = spark.createDataFrame([(1, "a", True), (2, "b", False), (5, "e", True)], "id long, name string, is_active boolean")
    results = []
    for how in ({}, {"hot_rows": 4, "blocks": 3}):
        snapshot, report = upsert_master(current, changes, "id", T0, **how)
        results.append((sorted(snapshot.collect()), sorted(report.collect())))
    assert results[0] == results[1]
    state, name = {1: True, 2: False, 5: True}, {1: "a", 2: "b", 5: "e"}
    for _, action, key, value in sorted(rows):
        state[key] = {"insert": True, "activate": True, "deactivate": False}.get(action, (not state[key] if state.get(key) is not None else None) if action == "toggle" else state.get(key))
        if action in ("insert", "update") and value:
            name[key] = value
    known = {r.id: (r.name, r.is_active) for r in results[0][0]}
    assert all(known[k] == (name[k], state[k]) for k in (1, 2, 5))


def test_keyset_pages_add_up_with_nulls(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2]), rng.choice([None, "a", "b"])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a long, b string")
    for keys in ([("a", True), ("b", False), ("id", True)], [("a", False), ("b", True), ("id", False)]):
        seen, after = [], None
        while page := paginate_keyset(df, keys, 7, after).collect():
            seen += [r.id for r in page]
            after = [page[-1][k] for k, _ in keys]
        assert sorted(seen) == list(range(40)) and len(seen) == 40


def test_cascade_goes_down_to_the_last_level(spark):
    led = Ledger(
        courses=spark.createDataFrame([(1,), (2,)], "id long"),
        students=spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, course_id long"),
        payments=spark.createDataFrame([(100, 10), (101, 11), (102, 12)], "id long, student_id long"),
        users=spark.createDataFrame([], "id long"),
        logs=spark.createDataFrame([], "id long, user_id long"),
    )
    after = cascade_deletes(spark.createDataFrame([(1,)], "id long"), led, "courses", "cascade")
    assert [r.id for r in after.students.orderBy("id").collect()] == [11, 12]
    assert [r.id for r in after.payments.orderBy("id").collect()] == [101, 102]


@pytest.mark.parametrize("code", ["code", None])
@pytest.mark.parametrize("hot_rows", [1000, 1])
def test_used_codes_are_used_up(spark, code, hot_rows):
    def at(m):
        return T0 + timedelta(minutes=m)

    issues = spark.createDataFrame([(1, "c", at(0), 1, False), (1, "c", at(6), 4, False), (2, "c", at(0), 9, False)], "k long, code string, ts timestamp_ntz, id long, supersedes boolean")
    attempts = spark.createDataFrame([(1, "c", at(1), 2), (1, "c", at(3), 3), (1, "c", at(7), 5), (2, "c", at(5), 6), (1, "c", at(2), 7)], "k long, code string, ts timestamp_ntz, id long")
    uses = spark.createDataFrame([(1, at(2))], "k long, ts timestamp_ntz")
    got = match_within_validity(issues, attempts, ["k"], code, timedelta(minutes=10), hot_rows, 3, uses)
    assert {r.id: r.valid for r in got.collect()} == {2: True, 3: False, 5: True, 6: True, 7: True}


def test_a_hot_student_leaves_before_the_join(spark):
    """The plan joins ordinary students without the rows of the hot one."""
    rows = [(1 if i % 3 == 0 else i, i, str(i % 7), "cash") for i in range(600)]
    incoming = spark.createDataFrame(rows, "student_id long, id long, amount_paid string, payment_method string").repartition(4)
    accounts = spark.createDataFrame([(i, D(50)) for i in range(600)], "student_id long, open decimal(22,2)")
    from tallybook.plans.ordered import split_hot

    split = split_hot(incoming, ["student_id"], 100)
    assert split.cold.where("student_id = 1").count() == 0 and split.hot.count() == 201
    got = admit_against(incoming, accounts, ("id",), 100, 4)
    assert got.where(F.col("student_id") == 1).count() == 201 and got.count() == 600


def test_throttle_composes_only_keys_that_blocks_part(spark, monkeypatch):
    """A thousand keys above the limit: block functions are made for those that a cut parts, fewer than the blocks."""
    from tallybook.operators import rates

    made = []

    def counted(df):
        out = durable(df)
        if "entry" in out.columns:
            made.append(out.select("_key").distinct().count())
        return out

    durable = rates.durable
    monkeypatch.setattr(rates, "durable", counted)
    rng = random.Random(5)
    rows = [(k or None, T0 + timedelta(seconds=rng.randrange(60)), k * 8 + i) for k in range(1000) for i in range(8)]
    events = spark.createDataFrame(rows, "k long, ts timestamp_ntz, id long")
    gap = timedelta(seconds=9)
    got = throttle(events, "k", "ts", "id", gap, fold_rows=5, blocks=6, fan_in=2).collect()
    assert {r.id: r.allowed for r in got} == brute.throttle([(k or 0, ts, i) for k, ts, i in rows], gap)
    assert made and max(made) <= 5
