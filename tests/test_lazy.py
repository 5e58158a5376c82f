"""Graphs make a table when a query asks for it, and once."""

import pytest

from hinspark import queries
from hinspark.graph import HinGraph, Tables
from hinspark.operators import atomize
from hinspark.sources.relational import commerce
from hinspark.types import CEType


@pytest.fixture
def written(monkeypatch):
    names = []
    real = atomize.written
    monkeypatch.setattr(atomize, "written", lambda df, name: names.append(name) or real(df, name))
    return names


def test_what_a_query_does_not_touch_is_not_written(spark, sf_dir, written):
    for name in ("self_loops", "inverse_edges", "srgcn_layer", "node_homophily_all", "homogenize"):
        queries.QUERIES[name](spark, sf_dir)
    assert written == []
    queries.QUERIES["metapath_adj_brand_customer"](spark, sf_dir)
    assert len(written) == 1


def test_ids_are_written_once_for_nodes_edges_and_inverses(spark, sf_dir, written):
    g = commerce(spark, sf_dir)
    h = g.without_etypes(["home-of"]).with_self_loops(["brand"])
    for graph in (g, h):
        graph.nodes["brand"], graph.edge("has-brand"), graph.edge("brand-of")
    assert len(written) == 1


def test_tables_are_made_when_asked_for(spark):
    made = []
    tables = Tables({"a": lambda: made.append("a") or spark.range(1), "b": spark.range(2)})
    both = tables | {"c": lambda: made.append("c") or spark.range(3)}
    assert "a" in both and len(both) == 3 and list(both.only(["c", "a"])) == ["c", "a"] and made == []
    assert both["a"] is tables["a"] is both.only(["a"])["a"] and made == ["a"]
    with pytest.raises(KeyError):
        tables["c"]


def test_meta_and_inverses_touch_no_table():
    refuse = lambda: pytest.fail("made")
    c = CEType("a", "to", "b")
    g = HinGraph({"a": refuse, "b": refuse}, {c: refuse}, target="b").with_inverses().with_self_loops()
    assert len(g.meta.cetypes) == 4 and g.without_etypes(["to-inv"]).meta.reaching("b") == {"a", "b"}
