"""Runs a registered query beside its SQL and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.sql(sql).df()


def plain(frame):
    """Rows as tuples in the order of column names, sorted, with numbers and nulls alike."""

    def value(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        return float(v) if hasattr(v, "__float__") and not isinstance(v, str) else v

    columns = sorted(frame.columns)
    rows = [tuple(value(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)]
    return columns, sorted(rows, key=repr)


def check(spark, name: str, sf_dir: str, queries, oracles) -> None:
    assert plain(queries[name](spark, sf_dir).toPandas()) == plain(sql_rows(oracles[name], sf_dir))
