"""Every registered query against its SQL, and the entry module without the optional parts."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidewell.plans import conformance, further, rules  # noqa: F401  they register their queries
from tidewell.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db


def plain(df: pd.DataFrame) -> list[tuple]:
    def show(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
            return str(v)
        if pd.isna(v):
            return None
        if isinstance(v, float):
            return f"{v:.6g}"
        text = str(v)
        return text.removesuffix(" 00:00:00")

    return sorted((tuple(map(show, row)) for row in df[sorted(df.columns)].to_numpy(dtype=object)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tables, name):
    got, want = QUERIES[name](spark, SF).toPandas(), tables.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_optional_parts(tmp_path):
    code = """
        import sys
        class Absent:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("tidewell.llm"):
                    raise ModuleNotFoundError(name, name=name)
        sys.meta_path.insert(0, Absent())
        import __spark_entry__ as e
        assert "price_history_change_points" in e.queries() and "pipeline" not in e.queries() and e.oracle_sql()
    """
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=root, check=True, timeout=120)
