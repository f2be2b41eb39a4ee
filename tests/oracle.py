"""Spark and DuckDB side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def value(v):
    if isinstance(v, float):
        # The sign of a zero counts: -0.0 and 0.0 are different values.
        return "nan" if v != v else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return str([value(x) for x in v])
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(value(r[i]) for i in order) for r in data)


def compare(df, sql, con):
    result = con.execute(sql)
    names, expected = [d[0] for d in result.description], result.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, expected)
