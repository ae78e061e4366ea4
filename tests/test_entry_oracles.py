"""Driver contract and every SQL oracle at sf 0.001 (exact row multisets)."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"boosted_trees_score", "feature_importance_topk", "joint_embedding_score", "visit_embedding"}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in recs)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "cdr_worsened_after_v2" in df.columns


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 75


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
         "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, cur.fetchall())
    dtypes = {r[0]: r[1] for r in duck.execute(f"DESCRIBE ({E.oracle_sql()[name]})").fetchall()}
    stypes = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert stypes == dtypes


def test_driver_style_run_from_another_folder(tmp_path):
    """A plain session in a process started elsewhere: executors' Python workers must still
    import the package (it is shipped with addPyFile)."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        "import importlib.util, sys\n"
        f"spec = importlib.util.spec_from_file_location('entry_mod', {os.path.join(repo, '__spark_entry__.py')!r})\n"
        "E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert E.entry(spark).count() > 0\n"
        f"n = E.queries()['score_text_batch'](spark, {SMALL!r}).count()\n"
        "print('OK', n)\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=600)
    assert "OK" in out.stdout, out.stderr[-2000:]


def test_survey_queries_without_a_dependency_of_the_training_data():
    """The other queries stay whatever the training-data subpackage misses."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = ("import sys\n"
              "for m in {blocked!r}:\n    sys.modules[m] = None\n"
              f"sys.path.insert(0, {repo!r})\n"
              "import __spark_entry__ as E\n"
              "from panelspark.plans.catalog import REGISTRY\n"
              "q, o = E.queries(), E.oracle_sql()\n"
              "assert set(q) == set(REGISTRY) and set(o) <= set(q), set(q) ^ set(REGISTRY)\n"
              "print('OK', len(q))\n")
    for blocked in (["public_tokenizers"], ["panelspark.llm"], ["corpus_pipeline"], ["panelspark.llm.bpe"]):
        out = subprocess.run([sys.executable, "-c", script.format(blocked=blocked)], capture_output=True, text=True, timeout=120)
        assert "OK" in out.stdout, (blocked, out.stderr[-2000:])
