"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    pdf = pdf.where(pdf.notna(), None)
    rows = sorted(pdf.itertuples(index=False, name=None), key=repr)
    return pd.DataFrame(rows, columns=pdf.columns, dtype=object)


def difference(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    a, b = canonical(spark_pdf), canonical(sql_pdf)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} != {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for i, (x, y) in enumerate(zip(a.itertuples(index=False), b.itertuples(index=False))):
        for name, left, right in zip(a.columns, x, y):
            same = left == right or (
                isinstance(left, float) and isinstance(right, float) and abs(left - right) < 1.5e-6
            )
            if type(left) is not type(right) and left is not None and right is not None:
                if not {type(left), type(right)} <= {int, float}:
                    same = False
            if not same:
                return f"row {i} column {name}: {str(left)[-300:]!r} != {str(right)[-300:]!r} in {str(x)[:200]}"
    return None


def check(spark, con, name, build, sql, sf_dir):
    start = time.time()
    df = build(spark, sf_dir)
    got = df.toPandas()
    took = time.time() - start
    start = time.time()
    result = con.execute(sql)
    want = result.df()
    types = {d[0]: str(d[1]) for d in result.description}
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pairs = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = {n: (k, types.get(n)) for n, k in kinds.items() if k in pairs and types.get(n) not in (pairs[k],)}
    problem = difference(got, want)
    return took, time.time() - start, len(got), problem, wrong


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from sievework.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                              "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            if name in oracles:
                took, sql_took, n, problem, wrong = check(spark, con, name, build, oracles[name], sf_dir)
                state = "ok  " if problem is None else "DIFF"
                bad += problem is not None
                print(f"{state} {name} rows={n} spark={took:.1f}s sql={sql_took:.1f}s", problem or "", wrong or "", flush=True)
            else:
                start = time.time()
                n = build(spark, sf_dir).count()
                print(f"rows {name} rows={n} spark={time.time() - start:.1f}s", flush=True)
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:700]}", flush=True)
    print("bad:", bad)
