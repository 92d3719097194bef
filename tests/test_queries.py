"""Every core query that has SQL gives the SQL's rows; the others run and keep their schema."""

import importlib.util
import os
import subprocess
import sys

import pytest
from oracle import connect, rows_of, rows_of_sql

from locusloom.plans import CORE_QUERIES, CORE_SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_matches_sql(spark, sf, con, name):
    assert rows_of(CORE_QUERIES[name](spark, sf)) == rows_of_sql(con, CORE_SQL[name])


#: Queries without SQL, each held against a restatement of the whole query in test_restated.py or test_problems.py.
RESTATED = {"p2_wide_all", "q47_exact_reciprocal", "q50_kmeans", "q59_spacing_test", "q75_metaclusters", "q76_long_read_calls", "q81_short_read_calls"}


def test_every_query_without_sql_is_restated():
    assert set(CORE_QUERIES) - set(CORE_SQL) == RESTATED


def test_whole_haplotypes_score_every_position(spark, sf):
    want = max(len(r[0]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect())
    got = {r["pos"] for r in CORE_QUERIES["q72_diagnostic_scores"](spark, sf).select("pos").distinct().collect()}
    assert want == 64 and got == set(range(1, want + 1))


_HIDE = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError("hidden", name={found!r})
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from locusloom.plans import CORE_QUERIES, CORE_SQL
assert set(e.queries()) == set(CORE_QUERIES) and set(e.oracle_sql()) == set(CORE_SQL)
"""


def run_hidden(name, found):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return subprocess.run([sys.executable, "-c", _HIDE.format(name=name, found=found)], cwd=root, capture_output=True, text=True)


def test_entry_imports_without_llm():
    assert run_hidden("locusloom.llm", "locusloom.llm").returncode == 0


@pytest.mark.skipif(importlib.util.find_spec("locusloom.llm") is None, reason="the subpackage is not there")
def test_a_fault_inside_llm_is_not_taken_for_its_absence():
    got = run_hidden("locusloom.llm.queries", "something_else")
    assert got.returncode != 0 and "hidden" in got.stderr
