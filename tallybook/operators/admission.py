"""Admission of payments without overpaying an account.

A payment is accepted if it fits into what is still owed; a refused one leaves
the balance as it is.  Each verdict therefore depends on the earlier ones and a
plain running sum gives wrong answers.

* Ordinary students: one ``aggregate`` over the student's sorted payments.
* Students with more than ``fold_rows`` payments: rounds of block scans, see
  :func:`_admit_hot`.  Neither way holds such a student in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.ledger import Ledger
from tallybook.plans.durable import durable
from tallybook.plans.ordered import BLOCK, POS, Running, range_blocks, scan_blocks, split_hot
from tallybook.plans.skew import one_per_key
from tallybook.plans.totals import with_course, with_paid

FOLD_ROWS = 10_000
MONEY = "decimal(22,2)"
GIVEN = "decimal(30,8)"
ACCEPTED, ALREADY_PAID, EXCEEDS = "accepted", "already_paid", "exceeds_balance"


def open_accounts(led: Ledger) -> DataFrame:
    """(student_id, open): price minus payments so far; ``open`` is NULL without a price."""
    return with_course(with_paid(led.students, led.payments), led.courses).select(
        F.col("id").alias("student_id"),
        (F.col("course_price") - F.col("total_paid")).cast(MONEY).alias("open"),
    )


def admit_payments(
    incoming: DataFrame,
    led: Ledger,
    order: tuple[str, ...] = ("created_at", "id"),
    fold_rows: int = FOLD_ROWS,
    blocks: int | None = None,
) -> DataFrame:
    """``incoming`` plus ``verdict``: ``accepted`` or the first failing check.

    Checks in order: amount and method given, amount a positive number, student
    known, course price known, not yet paid in full, fits the balance.  Inactive
    students may pay.
    """
    return admit_against(incoming, open_accounts(led), order, fold_rows, blocks)


def admit_against(
    incoming: DataFrame,
    accounts: DataFrame,
    order: tuple[str, ...] = ("created_at", "id"),
    fold_rows: int = FOLD_ROWS,
    blocks: int | None = None,
) -> DataFrame:
    """:func:`admit_payments` against given open balances."""
    due = accounts.select(F.col("student_id").alias("_sid"), F.col("open").alias("_open"))
    split = split_hot(incoming, ["student_id"], fold_rows)
    out = _admit_cold(_checked(split.cold, one_per_key(due, "_sid")), incoming.columns, order)
    if split.hot is None:
        return out
    theirs = due.join(split.hot_side().select(F.col("student_id").alias("_hot")), F.col("_sid") == F.col("_hot"), "left_semi")
    theirs = F.broadcast(theirs) if split.few_keys else one_per_key(theirs, "_sid")
    by = [F.col(c).asc() for c in (*order, "_amount")]
    cut = range_blocks(_checked(split.hot, theirs), ["student_id"], by, blocks or split.blocks)
    return out.unionByName(_admit_hot(cut, incoming.columns, split.few_keys))


def _checked(incoming: DataFrame, due: DataFrame) -> DataFrame:
    """Amounts, open balances and the verdicts that need no order.

    ``_amount`` is the number as given and what the checks compare; ``_paid``
    is what a payment takes from the balance, in whole cents.  A number beyond the
    type is larger than any balance.
    """
    given = F.col("amount_paid")
    beyond = F.lit("1e21").cast(GIVEN)
    amount = F.coalesce(given.try_cast(GIVEN), F.when(given.try_cast("double").between(1e21, float("inf")), beyond))
    rows = incoming.withColumn("_amount", amount).withColumn("_paid", F.round("_amount", 2).try_cast(MONEY))
    rows = rows.join(due, F.col("student_id") == F.col("_sid"), "left")

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""

    verdict = (
        F.when(blank("amount_paid") | blank("payment_method"), "missing_field")
        .when(F.coalesce(F.col("_amount") <= 0, F.lit(True)), "invalid_amount")
        .when(F.col("_sid").isNull(), "unknown_student")
        .when(F.col("_open").isNull(), "no_price")
        .when(F.col("_open") <= 0, ALREADY_PAID)
    )
    return rows.withColumn("_settled", verdict).drop("_sid")


def _admit_cold(rows: DataFrame, columns: list[str], order: tuple[str, ...]) -> DataFrame:
    """One fold per student; verdicts that are settled already pass through it."""
    sorted_rows = F.array_sort(
        F.collect_list(
            F.struct(
                *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                "_amount",
                "_paid",
                "_settled",
                F.struct(*columns).alias("row"),
            )
        )
    )
    per_student = rows.groupBy("student_id").agg(
        sorted_rows.alias("rows"), F.max("_open").alias("_open")
    )

    def step(acc: Column, x: Column) -> Column:
        fits = x["_settled"].isNull() & (x["_amount"] <= acc["open"])
        code = F.when(acc["open"] <= 0, ALREADY_PAID).when(fits, ACCEPTED).otherwise(EXCEEDS)
        left = F.when(fits & (acc["open"] > 0), (acc["open"] - x["_paid"]).cast(MONEY)).otherwise(acc["open"])
        return F.struct(
            left.alias("open"), F.concat(acc["codes"], F.array(F.coalesce(x["_settled"], code))).alias("codes")
        )

    start = F.struct(F.col("_open").alias("open"), F.array().cast("array<string>").alias("codes"))
    folded = per_student.select("rows", F.aggregate("rows", start, step)["codes"].alias("codes"))
    one = F.explode(F.arrays_zip("rows", "codes")).alias("x")
    return folded.select(one).select("x.rows.row.*", F.col("x.codes").alias("verdict"))


def _admit_hot(cut: DataFrame, columns: list[str], few_students: bool) -> DataFrame:
    """Exact verdicts for students whose payments fill many blocks.

    While more than half of the balance b is open, every payment up to b/2 fits,
    so those are a running sum S; the first larger one with amount <= b - S
    fits too.  A round ends at that larger payment or where S reaches b/2,
    whichever comes first, and leaves at most b/2.  Payments above b can never
    fit any more and drop out.  So the rounds are at most log2(price in cents),
    each is one block scan, and the later ones see ever fewer rows.
    """

    def side(per_student: DataFrame) -> DataFrame:
        """One row per hot student: broadcast if there are few, else open to splitting."""
        return F.broadcast(per_student) if few_students else one_per_key(per_student, "student_id")

    live = cut.where("_settled is null").select("student_id", BLOCK, POS, "_amount", "_paid", "_open")
    state = durable(
        live.groupBy("student_id").agg(F.max("_open").alias("b"), F.lit(-1).cast("long").alias("after"))
    )
    rounds: list[DataFrame] = []
    while not state.isEmpty():
        live = durable(
            live.select("student_id", BLOCK, POS, "_amount", "_paid")
            .join(side(state), "student_id", "inner")
            .where((F.col(POS) > F.col("after")) & (F.col("_amount") <= F.col("b")))
        )
        rounds.append(durable(_halve(live, state)))
        state = (
            rounds[-1]
            .where("stop is not null and left_open > 0")
            .select("student_id", F.col("left_open").alias("b"), F.col("stop").alias("after"))
        )
    if not rounds:
        return cut.select(*columns, F.col("_settled").alias("verdict"))
    history = (
        reduce(DataFrame.unionByName, rounds)
        .groupBy("student_id")
        .agg(F.collect_list(F.struct("b", "after", "stop", "stop_small", "left_open")).alias("rounds"))
    )
    pos, amount = F.col(POS), F.col("_amount")

    def taken(r: Column) -> Column:
        inside = (pos > r["after"]) & (r["stop"].isNull() | (pos <= r["stop"]))
        last = (pos == r["stop"]) & ~r["stop_small"]
        return inside & (_small(amount, r["b"]) | F.coalesce(last, F.lit(False)))

    paid_off = F.array_max(
        F.transform(F.filter("rounds", lambda r: r["left_open"] == 0), lambda r: r["stop"])
    )
    verdict = (
        F.when(F.col("_settled").isNotNull(), F.col("_settled"))
        .when(F.exists("rounds", taken), ACCEPTED)
        .when(F.coalesce(pos > paid_off, F.lit(False)), ALREADY_PAID)
        .otherwise(EXCEEDS)
    )
    return cut.join(side(history), "student_id", "left").select(*columns, verdict.alias("verdict"))


def _small(amount: Column, b: Column) -> Column:
    return amount * 2 <= b


def _halve(live: DataFrame, state: DataFrame) -> DataFrame:
    """One round for every open student: where it stops and what is left then."""
    b, amount = F.col("b"), F.col("_amount")
    small = _small(amount, b)
    fed = live.select(
        "student_id", BLOCK, POS, "_amount", "_paid", "b", F.when(small, F.col("_paid")).otherwise(F.lit(0).cast(MONEY)).alias("_in_s")
    )
    scanned = scan_blocks(fed, ["student_id"], [Running("s", "sum")])
    s = F.col("s").cast(MONEY)
    ends = F.when(small, (b - s) * 2 <= b).otherwise(amount + s <= b)
    spent = s + F.when(small, F.lit(0)).otherwise(F.col("_paid"))
    found = scanned.groupBy("student_id").agg(
        F.min(F.when(ends, F.struct(F.col(POS).alias("pos"), small.alias("small"), spent.cast(MONEY).alias("spent")))).alias("e")
    )
    left_open = (b - F.col("e.spent")).cast(MONEY)
    return state.join(found, "student_id", "left").select(
        "student_id",
        "b",
        "after",
        F.col("e.pos").alias("stop"),
        F.col("e.small").alias("stop_small"),
        left_open.alias("left_open"),
    )


def split_admitted(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted payments, ready to append; refused ones with their verdict)."""
    ok = F.col("verdict") == ACCEPTED
    return judged.where(ok).drop("verdict"), judged.where(~ok)
