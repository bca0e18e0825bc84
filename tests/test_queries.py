"""Every query of the registry against its SQL on the smallest tables; nothing outside the subpackage needs it."""

import ast
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from compare import rows_of  # noqa: E402

from tessera.plans import registry  # noqa: E402

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for p in Path(folder).iterdir():
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, folder, duck, name):
    df = registry.QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(registry.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, folder, name):
    n = registry.QUERIES[name](spark, folder).count()
    assert n > 0 or name == "stock_balance"  # sound sheets balance


def test_models_beat_the_naive_forecast(spark, folder):
    rows = {(r.model, r.split): r.rmse for r in registry.QUERIES["demand_model_eval"](spark, folder).collect()}
    assert min(rows["linear", "test"], rows["tree", "test"]) < rows["lag7", "test"]


def test_nothing_outside_imports_the_subpackage():
    for p in [*ROOT.glob("tessera/**/*.py"), *ROOT.glob("tools/*.py"), ROOT / "bench.py"]:
        if "llm" in p.parts or not p.exists():
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("tessera.llm") for n in names), p
