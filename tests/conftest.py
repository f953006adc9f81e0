import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from catalink.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


def rounded(v):
    import decimal
    import math

    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(rounded, v))
    return v


def against_sql(spark, df, sql, folder):
    """Rows of a DataFrame and of SQL over the same tables, columns in order of their names."""
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = sorted((tuple(rounded(r[c]) for c in order) for r in df.collect()), key=repr)
    b = sorted((tuple(rounded(r[names.index(c)]) for c in order) for r in got.fetchall()), key=repr)
    assert a == b


@pytest.fixture(scope="session")
def same_as_sql(spark):
    return lambda df, sql, folder="/root/testdata/sf0.001": against_sql(spark, df, sql, folder)
