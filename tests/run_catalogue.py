"""Command line check: python tests/run_catalogue.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import pathlib
import sys
import time
import traceback

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from tests.compare import compare, connect
from tabforge.session import get_spark


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", **{"spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false",
                                     "spark__driver__memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in sorted(entry.queries().items()):
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, oracles[name], con)
                note = "ok" if problem is None else f"DIFF {problem[:900]}"
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
                note = f"rows {n}"
        except Exception:
            problem, note = "error", "ERROR " + traceback.format_exc()[-1500:]
        failed += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
