import glob
import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SLOW = {"persistence_pairs", "persistence_filter", "corridor_colours", "macro_strings"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def test_entry_gives_critical_points(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not os.environ.get("FAST") and n not in SLOW))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, DATA)
    got = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(rows, key=repr)
    want = key(tuple(plain(r[names.index(n)]) for n in df.columns) for r in got.fetchall())
    assert key(tuple(map(plain, r)) for r in df.collect()) == want
