import duckdb


def rows(frame):
    cols = sorted(frame.columns)
    clean = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(float(x) if isinstance(x, float) else x for x in map(clean, r))) for r in frame[cols].itertuples(index=False))


def same_as_sql(df, sql, tables):
    c = duckdb.connect()
    for name, t in tables.items():
        c.register(name, t.toPandas() if hasattr(t, "toPandas") else t)
    assert rows(df.toPandas()) == rows(c.execute(sql).fetchdf())
