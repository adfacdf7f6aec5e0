"""python tests/run_oracle.py [folder] [query ...]: compare queries with their SQL, with times."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from holdfast.plans import catalogue  # noqa: E402
from holdfast.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session(cpus=8)
    db = connect(folder)
    sql = catalogue.oracle_sql()
    bad = 0
    for name, fn in catalogue.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sql:
                problem = compare(db, df, sql[name])
            else:
                problem = None
                print(f"   (no SQL) {name}: {len(df.collect())} rows")
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} bad")
