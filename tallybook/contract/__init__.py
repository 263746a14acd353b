from tallybook.contract import account_cases, activity_cases, payment_cases, stream_cases, write_cases
from tallybook.contract.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
