import pytest
from oracle import connect, rows_of, rows_of_sql

from locusloom.llm.queries import LLM_QUERIES, LLM_SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_matches_sql(spark, sf, con, name):
    assert rows_of(LLM_QUERIES[name](spark, sf)) == rows_of_sql(con, LLM_SQL[name])


@pytest.mark.parametrize("name", sorted(set(LLM_QUERIES) - set(LLM_SQL)))
def test_runs(spark, sf, name):
    assert LLM_QUERIES[name](spark, sf).count() > 0


def test_pieces_agree_with_kinds(spark, sf):
    pieces = LLM_QUERIES["p1_pieces"](spark, sf).groupBy("item_kind", "item_id").agg({"forced": "max"}).collect()
    found = {(r["item_kind"], r["item_id"], r["cut_kind"] == "forced") for r in LLM_QUERIES["p1_found"](spark, sf).collect()}
    assert found == {(r["item_kind"], r["item_id"], r["max(forced)"]) for r in pieces}
