"""Order-insensitive comparison of a Spark result with its DuckDB oracle."""

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(df: pd.DataFrame):
    df = df.reindex(sorted(df.columns), axis=1)
    out = []
    for r in df.itertuples(index=False):
        vals = []
        for v in r:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
                vals.append("NULL")
            elif isinstance(v, float):
                vals.append(str(int(v)) if v == int(v) else repr(round(v, 6)))
            elif hasattr(v, "isoformat"):
                s = str(v)
                vals.append(s[:10] if s[10:].strip(" 0:") == "" else s)
            elif hasattr(v, "__int__") and not isinstance(v, (str, bool)) and float(v) == int(v):
                vals.append(str(int(v)))
            else:
                vals.append(str(v))
        out.append("|".join(vals))
    return sorted(out)
