"""Command line: python tests/run_oracle.py [sf] [name ...]"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry_module
from flowquarry.session import build_session
from oracle import compare, connect

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
wanted = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = build_session(8)
con = connect(sf_dir)
queries, oracle = entry_module.queries(), entry_module.oracle_sql()
bad = 0
for name, fn in queries.items():
    if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
        continue
    start = time.time()
    try:
        df = fn(spark, sf_dir)
        if name in oracle:
            ok, why, n = compare(df, con, oracle[name])
        else:
            ok, why, n = True, "rows only", len(df.collect())
            ok = n > 0
    except Exception:
        ok, why, n = False, traceback.format_exc()[-1800:], 0
    bad += not ok
    print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {n:7d} rows {time.time() - start:6.1f}s {why}", flush=True)
print("failures:", bad)
