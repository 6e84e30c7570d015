"""Compare a query with its SQL in DuckDB, as the driver does: row count, names, types and values in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(value):
    return round(value, 9) + 0.0 if isinstance(value, float) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def same(spark, query, sql, folder):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    frame = query(spark, folder)
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert {k: TYPES.get(v, v) for k, v in frame.dtypes} == kinds
    assert rows(frame.columns, frame.collect()) == rows(names, result.fetchall())
