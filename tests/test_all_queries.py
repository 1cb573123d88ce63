"""Every core query against its SQL on the small tables."""

import datetime
import decimal

import __spark_entry__ as entry
import pytest

from declario.queries import ORACLE_SQL, QUERIES


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf_dir):
    import duckdb

    out = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        out.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, sf_dir, con, name):
    assert entry.oracle_sql()[name] == ORACLE_SQL[name]
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()]
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
