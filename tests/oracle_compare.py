"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/oracle_compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# DuckDB type of each Spark type.
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "tinyint": "TINYINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 6)
    return value


def compare(df, con, statement: str) -> list[str]:
    """Differences between a DataFrame and a statement, empty when they agree."""
    names = sorted(df.columns)
    result = con.execute(f"DESCRIBE {statement}").fetchall()
    types = {row[0]: row[1] for row in result}
    problems = []
    if sorted(types) != names:
        return [f"columns {names} against {sorted(types)}"]
    spark_types = dict(df.dtypes)
    for name in names:
        if TYPES.get(spark_types[name]) != types[name]:
            problems.append(f"type of {name}: {spark_types[name]} against {types[name]}")
    quoted = ", ".join(f'"{n}"' for n in names)
    want = Counter(tuple(_plain(v) for v in row) for row in con.execute(f"SELECT {quoted} FROM ({statement})").fetchall())
    got = Counter(tuple(_plain(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())
    if got != want:
        problems.append(f"rows {sum(got.values())} against {sum(want.values())}; only here {list((got - want).items())[:3]}; "
                        f"only there {list((want - got).items())[:3]}")
    return problems


def main() -> None:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from tests.session import session

    sf_dir, picked = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    statements, failed = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if picked and name not in picked:
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            problems = compare(df, con, statements[name]) if name in statements else [f"no SQL, {df.count()} rows"]
        except Exception as error:  # noqa: BLE001 - report and go on
            problems = [f"{type(error).__name__}: {str(error)[:500]}"]
        ok = not problems
        if not ok and name in statements:
            failed.append(name)
        print(f"{'ok  ' if ok else 'DIFF'} {name:28s} {time.time() - began:6.1f}s {' | '.join(problems)}", flush=True)
    print(f"failed: {failed}")


if __name__ == "__main__":
    main()
