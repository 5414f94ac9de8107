"""Side-by-side run of a query and its SQL, compared as sorted rows of normalised values."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=str)


def same(spark, folder, query, sql, con):
    df = query(spark, folder)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert len(got) == len(want)
    assert got == want


def split_otherwise(spark, folder, query, leave_out=()):
    """The rows of a query, the same with other numbers of tasks and partitions."""
    found = []
    for partitions, size in ((4, "128m"), (3, "20k")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = query(spark, folder)
            df = df.drop(*leave_out)
            found.append(rows(df.columns, df.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert found[0] == found[1]
    return found[0]
