"""Every query of the library against its SQL on the smallest tables; the driver's entry imports without the subpackage."""

import os

import duckdb
import pytest

from sensegauge.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 5) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    with duckdb.connect() as c:
        for t in TABLES:
            c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        found = c.sql(ORACLE_SQL[name])
        assert sorted(found.columns) == columns
        expected = [tuple(map(plain, r)) for r in c.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()]
    assert sorted(rows, key=str) == sorted(expected, key=str)
