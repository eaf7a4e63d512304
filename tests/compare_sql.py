"""A query's rows beside those of its SQL on the same tables."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if value is None or value != value:
        return ""
    return f"{round(value, 6):.6f}" if isinstance(value, float) else str(value)


def compare(spark, query, sql):
    df = query(spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(shown(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(shown(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert len(got) == len(want)
    assert [(g, w) for g, w in zip(got, want, strict=True) if g != w][:3] == []
