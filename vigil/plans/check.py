"""Run queries against their DuckDB oracles: ``python -m vigil.plans.check [sf_dir] [names…]``."""

from __future__ import annotations

import json
import os
import sys
import time
import traceback


def main(argv: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf_dir, argv = argv[0], argv[1:]
    from vigil.plans import registry
    from vigil.plans.checking import compare, duck_connect
    from vigil.session import build_session

    spark = build_session("local[8]", shuffle_partitions=8)
    registry.load_all()
    con = duck_connect(sf_dir)
    names = argv or sorted(registry.QUERIES)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = registry.QUERIES[name](spark, sf_dir)
            if name in registry.ORACLE:
                res = compare(df, con, registry.ORACLE[name])
            else:
                res = {"rows_only": df.count(), "match": None}
        except Exception as exc:  # report and continue
            res = {"error": f"{type(exc).__name__}: {str(exc)[:600]}", "match": False}
            if os.environ.get("VIGIL_VERBOSE"):
                traceback.print_exc(limit=3)
        res["sec"] = round(time.time() - t0, 2)
        if res.get("match") is False:
            bad += 1
        print(name, json.dumps(res, default=str), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
