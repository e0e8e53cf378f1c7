"""Comparing results with DuckDB's."""

import os

SF = "/root/testdata/sf0.001"


def canonical(rows, columns):
    """Rows as sorted tuples of text, columns by name, floats to six places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def against_duckdb(df, sql, sf=SF):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{file}')")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = canonical(cursor.fetchall(), names)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert sorted(df.columns) == sorted(names)
    assert got == want
