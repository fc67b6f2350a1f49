"""Command-line check: python tests/check_oracle.py [sf_dir] [name-prefix ...]"""

import sys
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            if name in sqls:
                good, message = compare(spark, fn, sqls[name], sf, con)
            else:
                good, message = True, f"rows only: {fn(spark, sf).count()}"
        except Exception as exc:  # noqa: BLE001
            good, message = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
            if len(names) == 1:
                traceback.print_exc()
        print("OK  " if good else "BAD ", name, message, flush=True)
        if not good:
            bad.append(name)
    print("failed:", bad)
    sys.exit(bool(bad))
