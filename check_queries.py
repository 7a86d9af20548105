"""Run registered queries against their SQL: ``python check_queries.py [folder] [name-prefix ...]``."""

import importlib
import sys
import time

sys.path.insert(0, "tests")
from compare import connect, differences  # noqa: E402

from headwise.plans.catalog import REGISTRY  # noqa: E402
from headwise.session import build_session  # noqa: E402


def main() -> int:
    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    try:
        from headwise.plans.catalog import load

        load()
    except ImportError as e:
        print("partial:", e)
        for m in ("analytics", "join", "feature", "scalar", "quality", "decision", "rollup", "model", "storage"):
            try:
                importlib.import_module(f"headwise.plans.{m}_queries")
            except ModuleNotFoundError:
                pass
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    bad = 0
    for name, q in REGISTRY.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = q.build(spark, root)
            problem = differences(df, con, q.sql) if q.sql else ([] if df.count() > 0 else ["no rows"])
        except Exception as e:  # report every query, then go on
            problem = [f"{type(e).__name__}: {str(e)[:700]}"]
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s" + ("" if q.sql else " (rows only)"), flush=True)
        for p in problem:
            print("     ", p, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
