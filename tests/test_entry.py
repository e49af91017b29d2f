"""What the driver calls, with and without the training-data operators."""

import os
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = [n for n in __spark_entry__._core.QUERIES]


def view(c, name, sf="sf0.001"):
    c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/{sf}/{name}.parquet')")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        view(c, t)
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    rows = [r.asDict() for r in got.collect()]
    if name not in __spark_entry__.oracle_sql():
        pytest.skip("runs; has no SQL to compare with")
    cursor = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = sorted(d[0] for d in cursor.description)
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert columns == sorted(got.columns)
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(text(r[at[c]]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_the_training_data_operators(tmp_path):
    import shutil

    shutil.copytree(os.path.join(ROOT, "scholarmill"), tmp_path / "scholarmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'impact' in q and not any(x.startswith('op') for x in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_walks_are_whole(spark):
    rows = __spark_entry__.queries()["node2vec_walks"](spark, "/root/testdata/sf0.01").collect()
    starts = {r.start for r in rows}
    assert len(rows) == 10 * len(starts) and max(r.path.count(",") + 1 for r in rows) >= 80
