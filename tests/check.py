"""python -m tests.check [sf] [name ...]: run registered queries against their SQL."""

import sys
import time
import traceback

import __spark_entry__ as entry
from bandloom.session import local_session
from tests.oracle import compare, duck

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(d)
    qs, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in [n for n in qs if not names or any(n.startswith(x) for x in names)]:
        t = time.time()
        try:
            if name in sql:
                why = compare(qs[name](spark, d), con, sql[name])
            else:
                n = len(qs[name](spark, d).collect())
                why = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            why = "".join(traceback.format_exception_only(e))[:1500]
        failed += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {time.time() - t:6.2f}s {name}{'' if name in sql else ' (rows)'} {why or ''}", flush=True)
    print("failed:", failed)
