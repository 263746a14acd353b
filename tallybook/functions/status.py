"""The payment-status rules.

The reports disagree on purpose about what "paid" means: the price test, the
treatment of a zero or missing price and the population all differ.  Each rule
is one entry here and they are never merged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLICIES = (
    "admin_dash",
    "admin_list",
    "admin_badge",
    "roster",
    "cashier_list",
    "per_payment",
    "last_payment",
)


def _tiers(paid: Column, price: Column, full: str, part: str, none: str) -> Column:
    return F.when(paid >= price, full).when(paid > 0, part).otherwise(none)


def signed_balance(paid: Column, price: Column) -> Column:
    """The balance the badge shows: price minus paid only when both are non-zero."""
    both = (F.coalesce(price, F.lit(0)) != 0) & (F.coalesce(paid, F.lit(0)) != 0)
    return F.when(both, price - paid).otherwise(F.coalesce(price, F.lit(0)))


def status_expr(paid: Column, price: Column, policy: str, is_last: Column | None = None) -> Column:
    """Status of an account (or of one payment) under ``policy``.

    ``paid`` is the account total; for ``per_payment`` the amount of that one
    payment.  ``last_payment`` also needs ``is_last``.  ``admin_list`` is a set
    of overlapping filters, not a partition: see :func:`status_filter`.
    """
    if policy == "admin_dash":
        return _tiers(paid, price, "fully_paid", "partially_paid", "unpaid")
    if policy == "roster":
        return _tiers(paid, price, "Paid", "Partial", "Unpaid")
    if policy == "per_payment":
        return _tiers(paid, price, "paid", "partial", "unpaid")
    if policy == "cashier_list":
        due = F.coalesce(price, F.lit(0))
        return F.when(due == 0, "no_billing").otherwise(_tiers(paid, due, "paid", "partial", "unpaid"))
    if policy == "last_payment":
        if is_last is None:
            raise ValueError("last_payment needs is_last")
        return (
            F.when(is_last & (paid >= price), "paid").when(paid > 0, "partial").otherwise("unpaid")
        )
    if policy == "admin_badge":
        settled = (signed_balance(paid, price) == 0) & (F.coalesce(price, F.lit(0)) != 0)
        return (
            F.when(settled, "Fully Paid").when(paid > 0, "Partially Paid").otherwise("Unpaid")
        )
    raise ValueError(f"no single status under policy {policy!r}")


def status_filter(paid: Column, price: Column, status: str, policy: str) -> Column:
    """The list-page filters.

    ``admin_list``: an overpaid account is in none of them, and an account
    without a price or with price 0 that never paid is ``unpaid``.
    ``cashier_list``: every filter also wants a positive price.
    """
    if policy == "admin_list":
        rules = {
            "paid": (price - paid == 0) & (price > 0),
            "partial": (paid > 0) & (price - paid > 0),
            "unpaid": paid == 0,
        }
    elif policy == "cashier_list":
        billed = F.coalesce(price, F.lit(0)) > 0
        rules = {
            "paid": (paid >= price) & billed,
            "partial": (paid > 0) & (paid < price) & billed,
            "unpaid": (paid == 0) & billed,
        }
    else:
        raise ValueError(f"policy {policy!r} has no list filter")
    return rules[status]
