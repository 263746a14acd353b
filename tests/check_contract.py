"""python tests/check_contract.py [sf_dir] [name ...]: compare queries with their oracles."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

import oracle
from tallybook import local_session

import __spark_entry__ as contract

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(contract.queries())
spark = local_session(8)
con = oracle.connect(sf_dir)
bad = 0
for name in names:
    t = time.time()
    try:
        got = contract.queries()[name](spark, sf_dir).toArrow()
        t1 = time.time() - t
        sql = contract.oracle_sql().get(name)
        t = time.time()
        want = con.execute(sql).to_arrow_table() if sql else None
        t2 = time.time() - t
        diff = oracle.compare(got, want) if sql else "no oracle"
    except Exception as e:  # report and go on
        diff, t1, t2, got = f"{type(e).__name__}: {str(e)[:900]}", 0, 0, ()
    bad += diff not in (None, "no oracle")
    print(f"{'ok  ' if diff is None else 'DIFF'} {name} rows={len(got)} spark={t1:.2f}s oracle={t2:.2f}s {diff or ''}", flush=True)
print("differences:", bad)
