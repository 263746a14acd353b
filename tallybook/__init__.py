"""Receivables analytics on Spark DataFrames.

Accounts (students), price plans (courses), payments, staff (users) and
activity events (logs) go in as DataFrames; every operator gives a DataFrame
back and leaves the physical plan to Catalyst.  "Now" is always an explicit
``as_of`` argument, never the wall clock.
"""

from tallybook.ledger import Ledger
from tallybook.session import local_session

__all__ = ["Ledger", "local_session"]
