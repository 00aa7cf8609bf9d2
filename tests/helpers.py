"""Compare a registered query with its oracle SQL, as the driver does."""

import math

import duckdb

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def same_as_oracle(spark, f, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, rel = f(spark, sf), con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    got = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=key)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(canon(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w, {c: (x, y) for c, x, y in zip(cols, g, w) if x != y}
    short = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float"}
    kinds, mine = {c: str(t) for c, t in zip(rel.columns, rel.types)}, dict(df.dtypes)
    assert not {c: (mine[c], kinds[c]) for c in cols if short.get(kinds[c], kinds[c]) != mine[c]}
    return got
