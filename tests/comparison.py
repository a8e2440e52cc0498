"""Order-insensitive comparison of a Spark result with the SQL result."""

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is not None, str(v)) for v in r))


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return cursor.fetchall(), columns


def differences(df, con, sql):
    """Empty list when equal, else a few lines that say how not."""
    expected, columns = sql_rows(con, sql)
    got = df.toPandas()
    if sorted(columns) != sorted(got.columns):
        return [f"columns {sorted(got.columns)} != {sorted(columns)}"]
    got_rows = canonical(list(got.astype(object).where(pd.notnull(got), None).itertuples(
        index=False, name=None)), list(got.columns))
    want_rows = canonical(expected, columns)
    if len(got_rows) != len(want_rows):
        return [f"rows {len(got_rows)} != {len(want_rows)}"]
    return [f"{a} != {b}" for a, b in zip(got_rows, want_rows, strict=True) if a != b][:3]
