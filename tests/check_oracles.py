"""Compares registered queries with their SQL: python tests/check_oracles.py SF_DIR [PREFIX...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in v.items()) + "}"
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, run, sql, sf_dir):
    """None, or what differs."""
    df = run(spark, sf_dir)
    got = rows(df.columns, df.collect())
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = rows(names, con.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    kinds = {d[0]: str(d[1]).upper() for d in con.description}
    wide = [c for c, k in kinds.items() if k in ("HUGEINT", "INT128", "UBIGINT") or k.startswith("DECIMAL")]
    if wide:
        return f"wide types {wide}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return f"{len(got)} rows against {len(want)}; {odd}"
    return None


def main(sf_dir, *prefixes):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if (prefixes and not name.startswith(prefixes)) or name not in sqls:
            continue
        t = time.time()
        try:
            said = compare(spark, con, run, sqls[name], sf_dir)
        except Exception as e:  # report and go on
            said = f"{type(e).__name__} {str(e)[:500]}"
        if said:
            bad += 1
        print(f"{'bad' if said else 'ok '} {name} {time.time() - t:.1f}s {said or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
