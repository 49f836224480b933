"""Compare a Spark result with DuckDB running the oracle SQL on the same parquet files."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def rows_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_duck(con, sql):
    con.execute(f"CREATE OR REPLACE TEMP VIEW oracle_result AS {sql}")  # as the driver does
    rel = con.execute("SELECT * FROM oracle_result")
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted((tuple(_norm(r[i]) for i in idx) for r in data), key=repr)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
                 "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def type_problems(df, con, sql):
    """Column types must agree too (e.g. DuckDB's SUM over BIGINT is HUGEINT)."""
    rel = con.sql(sql)
    duck_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    out = []
    for name, st in df.dtypes:
        dt = duck_types.get(name)
        want = SPARK_TO_DUCK.get(st, st.upper())
        if dt is not None and dt != want and not (st.startswith("decimal") and dt.startswith("DECIMAL")):
            out.append(f"type of {name}: spark={st} duck={dt}")
    return out


def compare(df, con, sql):
    cs, rs = rows_spark(df)
    cd, rd = rows_duck(con, sql)
    problems = type_problems(df, con, sql)
    if cs != cd:
        problems.append(f"columns differ: spark={cs} duck={cd}")
    if len(rs) != len(rd):
        problems.append(f"row count spark={len(rs)} duck={len(rd)}")
    if rs != rd:
        only_s = [r for r in rs if r not in set(rd)][:5]
        only_d = [r for r in rd if r not in set(rs)][:5]
        problems.append(f"values differ; spark-only={only_s} duck-only={only_d}")
    return problems, len(rs)
