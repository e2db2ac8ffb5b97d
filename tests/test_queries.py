"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import numbers
import os
from pathlib import Path

import duckdb
import pytest

from tidemark import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def views():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def text(v):
    if v is None:
        return "NULL"
    if isinstance(v, int) and abs(v) >= 1 << 53:
        return str(v)
    if isinstance(v, numbers.Number):
        return "NULL" if v != v else repr(round(float(v), 7) + 0.0)
    return str(v)


def canonical(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [sorted(columns), *sorted(tuple(text(r[i]) for i in order) for r in rows)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    mine = queries.QUERIES[name](spark, SF)
    theirs = views().execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert canonical(mine.columns, mine.collect()) == canonical(names, theirs.fetchall())


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
