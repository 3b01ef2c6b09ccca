"""Compares a query's rows with those of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)

    def text(x):
        if x is None or (isinstance(x, float) and x != x):
            return "NULL"
        return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)

    return [names[k] for k in order], sorted(tuple(text(r[k]) for k in order) for r in rows)


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    df = query(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got == canonical(names, cur.fetchall())
