"""Compare queries with their SQL twins: python tools/check.py [sf] [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wattloom.session import local_session  # noqa: E402
from wattloom.workbench import catalog  # noqa: E402
from wattloom.workbench.compare import compare, duck  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("check")
    con = duck(sf_dir)
    bad = 0
    oracles = catalog.oracles()
    for name, fn in catalog.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                n, diff = compare(fn(spark, sf_dir), con, oracles[name])
            else:
                n, diff = len(fn(spark, sf_dir).collect()), []
        except Exception as e:  # noqa: BLE001
            n, diff = -1, [str(e)[:1500]]
        ok = "ok " if not diff else "BAD"
        kind = "sql" if name in oracles else "rows"
        print(f"{ok} {name:34s} {kind:4s} rows={n:<8d} {time.time() - t:6.2f}s", flush=True)
        for d in diff:
            print("     ", d[:900], flush=True)
        bad += bool(diff)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
