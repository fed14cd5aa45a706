"""Every query against DuckDB on the smallest tables; the entry without the optional subpackage."""

import decimal
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from treeloom import queries as Q

REPO = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return f"{float(v):.9g}" if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, sf, duck, name):
    own = Q.queries()[name](spark, sf)
    found = duck.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(own.columns)
    rows = lambda rs: sorted(tuple(map(plain, r)) for r in rs)
    assert rows(own.select(*columns).collect()) == rows(found.fetchall())


def test_results_are_plain(spark, sf):
    for name, q in Q.queries().items():
        for f in q(spark, sf).schema.fields:
            assert f.dataType.simpleString() in ("string", "bigint", "int", "double", "boolean"), (name, f)


def _without_llm(tmp_path):
    for item in ("treeloom", "__spark_entry__.py"):
        source = REPO / item
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / item)
    shutil.rmtree(tmp_path / "treeloom/llm", ignore_errors=True)


def test_works_without_the_optional_subpackage(tmp_path, sf):
    _without_llm(tmp_path)
    code = f"""
import re
import __spark_entry__ as e
from pyspark.sql import SparkSession

q = e.queries()
assert "xpath_flagship" in q and not any(re.match(r"op\\d|pipeline", n) for n in q) and q.keys() == e.oracle_sql().keys()
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert len(e.entry(spark).columns) == 2
assert all(q[n](spark, {sf!r}).count() for n in ("rule_rename_field", "xpath_root_child", "graph_roundtrip", "line_index"))
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=240)


def test_a_fault_inside_the_subpackage_is_not_hidden(tmp_path):
    _without_llm(tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode and "a_module_that_is_not_there" in done.stderr


@pytest.mark.parametrize("name", ["hash_dedup_subtrees", "xpath_json_field", "content_nested", "subtree_hashes"])
def test_no_node_table_is_broadcast(spark, sf, name):
    """Estimates of node tables are far too low, so they must not decide about what the driver takes in."""
    plan = Q.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
