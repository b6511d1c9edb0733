"""Run registered queries against their SQL: python check.py [--sf DIR] [name prefix ...]"""

import sys
import time

from barloom import get_session
from barloom.catalog import base, load
from tests.oracle import compare, duck

args = sys.argv[1:]
sf = "/root/testdata/sf0.01"
if args and args[0] == "--sf":
    sf, args = args[1], args[2:]
modules = [a[1:] for a in args if a.startswith("@")]
names = [a for a in args if not a.startswith("@")]
if modules:
    import importlib

    for m in modules:
        importlib.import_module(f"barloom.catalog.{m}")
    queries, oracles = base.QUERIES, base.ORACLES
else:
    queries, oracles = load()
spark, con, bad = get_session(cpus=8), duck(sf), 0
for name, fn in queries.items():
    if names and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in names):
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in oracles:
            problem, rows = compare(df, oracles[name], con), ""
        else:
            n = df.count()
            problem, rows = (None if n else "no rows"), f" rows={n}"
    except Exception as exc:
        problem, rows = f"{type(exc).__name__}: {str(exc)[:700]}", ""
    bad += problem is not None
    print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s{rows if not problem else ' ' + problem}"[:1100], flush=True)
print(f"{bad} failing")
