import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as e
from readsift.plans import queries, sql


def test_entry(spark):
    rows = e.entry(spark)
    assert rows.columns == ["read_ord", "category_idx", "num_hashes", "best_bin", "count", "unique_count", "prop", "unique_prop"]
    assert rows.where("count > 0").count() > 0


def test_package_can_be_shipped(tmp_path):
    path = tmp_path / "p.zip"
    path.write_bytes(e._package())
    code = f"import sys; sys.path.insert(0, {str(path)!r}); import readsift.plans.queries as q; assert '.zip' in q.__file__"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(sql.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "events", "supplier", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(sql.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in names]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
