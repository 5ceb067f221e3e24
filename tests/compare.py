"""Run queries and their SQL side by side: python tests/compare.py [sf] [name part ...]"""

import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(str(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql):
    """None when equal, else a short description."""
    mine = normalized(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    theirs = normalized([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} vs {theirs[0]}"
    only_mine, only_theirs = mine[1] - theirs[1], theirs[1] - mine[1]
    if only_mine or only_theirs:
        return (
            f"{sum(only_mine.values())} / {sum(only_theirs.values())} of {sum(mine[1].values())} rows differ: "
            f"{list(only_mine)[:2]} vs {list(only_theirs)[:2]}"
        )
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    for name, build in entry.queries().items():
        if sys.argv[2:] and not any(p in name for p in sys.argv[2:]):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            result = difference(df, con, sql[name]) if name in sql else (None if df.count() else 'no rows')
        except Exception as e:
            result = f"{type(e).__name__} {str(e)[:300]}"
        print(f"{'ok  ' if result is None else 'DIFF'} {name} {time.time() - start:.2f}s {result or ''}", flush=True)
