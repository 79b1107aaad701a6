"""Run registered queries against their SQL: ``python -m tests.oracle [name ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def engine(folder: str):
    con = duckdb.connect(config={"temp_directory": tempfile.mkdtemp(prefix="duckdb-")})
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


_KINDS = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "boolean": "BOOLEAN", "float": "FLOAT", "array<int>": "INTEGER[]", "array<string>": "VARCHAR[]",
    "array<double>": "DOUBLE[]", "date": "DATE",
}


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def compare(spark, folder: str, fn, sql: str | None):
    """Return (n_rows, problem or None)."""
    df = fn(spark, folder)
    names = sorted(df.columns)
    rows = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    if sql is None:
        return len(rows), None
    con = engine(folder)
    rel = con.execute(sql)
    described = {d[0]: str(d[1]) for d in rel.description}
    if sorted(described) != names:
        return len(rows), f"columns {names} vs {sorted(described)}"
    types = dict(df.dtypes)
    for n in names:
        if _KINDS.get(types[n], types[n]) != described[n]:
            return len(rows), f"type of {n}: {types[n]} vs {described[n]}"
    order = [list(described).index(n) for n in names]
    want = [tuple(_plain(r[i]) for i in order) for r in rel.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    rows.sort(key=key)
    want.sort(key=key)
    if len(rows) != len(want):
        return len(rows), f"{len(rows)} rows vs {len(want)}"
    for got, exp in zip(rows, want):
        if got != exp:
            return len(rows), f"{dict(zip(names, got))} vs {dict(zip(names, exp))}"
    return len(rows), None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from lamina.session import local_session

    folder = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("sf"):
        folder = f"/root/testdata/{argv.pop(0)}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    known, sqls = queries(), oracle_sql()
    bad = 0
    for name in argv or known:
        start = time.time()
        try:
            n, problem = compare(spark, folder, known[name], sqls.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            n, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        mark = "FAIL" if problem else ("ok" if name in sqls else "rows")
        print(f"{mark:5} {name:32} {n:8} rows {time.time() - start:6.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
