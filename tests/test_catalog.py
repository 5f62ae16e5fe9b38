"""Every registered query against its comparison SQL, and rules the registry keeps."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import DATA, compare, connect

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect("0.01")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    verdict, _ = compare(con, SQL.get(name), QUERIES[name](spark, str(DATA / "sf0.01")))
    assert verdict in ("ok", "rows-only"), verdict


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"route_key", "total", "completed", "failed"} <= set(rows[0].asDict())


def test_no_rows_are_left_out_and_no_lineage_is_cut_locally():
    package = Path(entry.__file__).parent / "inferbatch"
    for path in package.rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text, path
        assert not re.search(r"\.sample\(|\.toPandas\(|tablesample", text, re.I), path
