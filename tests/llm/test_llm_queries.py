"""The queries of the subpackage, against SQL where there is any."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))

from compare import rows_of  # noqa: E402

from tessera.llm import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.SQL:
        assert rows
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view order_items as select * from read_parquet('{folder}/order_items.parquet')")
    cur = con.execute(registry.SQL[name])
    columns = [d[0] for d in cur.description]
    assert rows_of(df.columns, rows) == rows_of(columns, cur.fetchall())
