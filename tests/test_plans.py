import importlib
import subprocess
import sys
from pathlib import Path

from rill.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registry.QUERIES["tpch_q6"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in text
    text = plan(registry.QUERIES["tpch_q5"](spark, SF))
    assert "EqualTo(r_name,ASIA)" in text and "Python" not in text


def test_grouping_reuses_an_explicit_exchange(spark):
    assert plan(registry.QUERIES["hash_repartition"](spark, SF)).count("Exchange ") == 1


def test_ratio_is_one_pass(spark):
    assert plan(registry.QUERIES["ysbm_ratio"](spark, SF)).count("events.parquet") == 1


def test_entry_and_registry_agree(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).columns == ["n_name", "cnt"]


def test_library_stands_without_the_corpus_operators():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('rill.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'tpch_q5' in e.queries() and not any(n.startswith('op') for n in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
