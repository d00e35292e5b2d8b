"""Run registered queries against their DuckDB oracles: python scripts/check_oracles.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vitrine import registry  # noqa: E402
from vitrine.oracle.harness import compare  # noqa: E402
from vitrine.session import get_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = set(sys.argv[2:])
    spark = get_session()
    registry.load_all()
    bad = []
    for name, fn in registry.QUERIES.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            sql = registry.ORACLES.get(name)
            if sql is None:
                n = df.count()
                ok, msg = True, f"rows-only: {n} rows"
            else:
                ok, msg = compare(df, sql, sf)
        except Exception as e:  # report and continue
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:300]}"
        print(f"{'OK ' if ok else 'BAD'} {name:<28} {time.time() - t:6.1f}s  {msg[:400]}", flush=True)
        if not ok:
            bad.append(name)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
