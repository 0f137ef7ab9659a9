"""Run queries and their SQL side by side: ``python -m checks.compare [folder] [name ...]``."""

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks import catalog

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session(cores="8", memory="12g"):
    return (SparkSession.builder.master(f"local[{cores}]").appName("checks")
            .config("spark.sql.shuffle.partitions", cores).config("spark.driver.memory", memory)
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.session.timeZone", "UTC").getOrCreate())


def database(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for n in NAMES.split():
        path = Path(folder) / f"{n}.parquet"
        if path.exists():
            con.execute(f"create view {n} as select * from '{path}'")
    return con


def canonical(rows, columns):
    """Rows as sorted tuples, columns by name."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(repr(r[k]) for k in order) for r in rows))


def compare(spark, con, name, folder):
    """None if equal, else what differs. A query without SQL only has to run."""
    df = catalog.QUERIES[name](spark, folder)
    rows, columns = [tuple(r) for r in df.collect()], df.columns
    if name not in catalog.ORACLES:
        return None if rows else "no rows"
    cur = con.execute(catalog.ORACLES[name])
    sql_columns = [c[0] for c in cur.description]
    sql_rows = cur.fetchall()
    if sorted(columns) != sorted(sql_columns):
        return f"columns {sorted(columns)} / {sorted(sql_columns)}"
    a, b = canonical(rows, columns), canonical(sql_rows, sql_columns)
    if a == b:
        return None if rows else "no rows"
    return f"rows {len(rows)} / {len(sql_rows)}; " + "; ".join(
        c for c in map(lambda n: column_gap(n, columns, rows, sql_columns, sql_rows), columns) if c)


def column_gap(name, columns, rows, sql_columns, sql_rows):
    """How the values of one column differ, if they do, from the first odd character on."""
    mine = sorted(repr(r[columns.index(name)]) for r in rows)
    other = sorted(repr(r[sql_columns.index(name)]) for r in sql_rows)
    if mine == other:
        return ""
    left, right = sorted(set(mine) - set(other)), sorted(set(other) - set(mine))
    x, y = (left or [""])[0], (right or [""])[0]
    at = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return f"{name} {len(left)}/{len(right)} ...{x[max(0, at - 20):at + 40]!r} / ...{y[max(0, at - 20):at + 40]!r}"


def main(folder="/root/testdata/sf0.01", *names):
    spark, con = session(), database(folder)
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for name in names or catalog.QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as e:  # show every failing query, not only the first
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} of {len(names or catalog.QUERIES)} differ: {' '.join(bad)}")


if __name__ == "__main__":
    main(*sys.argv[1:])
