"""Compare a registered query with its SQL on DuckDB."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{files}'")
    return con


def plain(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, int):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26].replace("T00:00:00", "")
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return f"{float(value):.6g}" if float(value) != int(value) else str(int(value))
    return str(value)


def table_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, run, sql, sf_dir):
    df = run(spark, sf_dir)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert table_of(df.columns, df.collect()) == table_of(names, found.fetchall())
