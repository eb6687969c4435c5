"""Compares a query's rows with its DuckDB SQL."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values, columns):
    def plain(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        return bytes(v) if isinstance(v, bytearray) else v

    return sorted((tuple(plain(r[c]) for c in columns) for r in values), key=repr)


def check(spark, query, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    result = con.sql(sql)
    assert sorted(result.columns) == columns
    expected = [dict(zip(result.columns, r, strict=True)) for r in result.fetchall()]
    assert rows([r.asDict() for r in df.collect()], columns) == rows(expected, columns)
