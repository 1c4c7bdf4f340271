"""Compares a query's rows with those of its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(repr([x.item() if hasattr(x, "item") else x for x in r]) for r in plain.itertuples(index=False, name=None))


def same(spark_frame, con, sql):
    assert rows(spark_frame.toPandas()) == rows(con.execute(sql).fetchdf())
