"""Every query of the core against its SQL equivalent on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from loomtrace.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return repr(round(float(x), 4) + 0.0)
    try:
        return repr(round(float(x), 4) + 0.0) if type(x).__name__ == "Decimal" else str(x)
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", ["a11_combinations", "a12_anchor_agreement", "a13_all_flags_means"])
def test_too_many_event_types(spark, tmp_path, name):
    spark.range(65).selectExpr("id as user_id", "timestamp'2024-01-01' as ts", "'t' || id as event_type", "1.0 as value").write.parquet(f"{tmp_path}/events.parquet")
    with pytest.raises(ValueError, match="event types"):
        QUERIES[name](spark, str(tmp_path))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    names = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    if name not in SQL:
        return
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(cols) == names
    assert rows == want
