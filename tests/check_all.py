"""Check all queries over one folder: python tests/check_all.py FOLDER [name prefixes]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from larder.session import local_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402


def main() -> None:
    folder, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, twins = connect(folder), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.perf_counter()
        try:
            if name in twins:
                wrong = differences(query(spark, folder), con, twins[name])
                said = "ok" if not wrong else f"DIFFERENT {wrong}"
            else:
                said = f"rows only: {query(spark, folder).count()}"
        except Exception:
            said = "ERROR " + traceback.format_exc(limit=-3)[-1500:]
        bad += said.startswith(("DIFF", "ERR"))
        print(f"{name:40} {time.perf_counter() - start:6.2f}s {said}", flush=True)
    print("not equal:", bad)


if __name__ == "__main__":
    main()
