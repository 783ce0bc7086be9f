"""Compare registered queries with their SQL oracles: python check_queries.py [name ...]."""

from __future__ import annotations

import os
import sys
import time
import traceback

from patronlens.checks.harness import compare, duck
from patronlens.plans.registry import load_all
from patronlens.session import local_session


def main() -> int:
    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    registered = load_all()
    wanted = sys.argv[1:]
    names = [n for n in registered if not wanted or any(w == n or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    spark = local_session("check")
    con = duck(folder)
    bad = 0
    for name in names:
        item = registered[name]
        start = time.time()
        try:
            frame = item.build(spark, folder)
            if item.oracle:
                problem = compare(frame, con, item.oracle)
            else:
                rows = frame.collect()
                problem = None if rows else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        took = time.time() - start
        bad += problem is not None
        if problem or os.environ.get("VERBOSE", "1") == "1":
            print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s {'' if item.oracle else '(rows only)'} {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} pass")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
