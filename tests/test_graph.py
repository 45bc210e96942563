"""Paths and neighbourhoods in graphs of any depth."""

from sparkloom.operators import graph as G

SCHEMA = "src long, dst long, type string"


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1, "view") for i in range(1, 100)] + [(200, 201, "view")], SCHEMA).coalesce(2)
    found = G.shortest_path(edges, 1, 100).first()
    assert found.length == 99 and found.path == list(range(1, 101))
    none = G.shortest_path(edges.filter("src > 90"), 91, 201).first()
    assert none.length is None and none.path is None


def test_ties_loops_and_own_node(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 1, "a"), (1, 3, "a"), (2, 4, "a"), (3, 4, "a"), (4, 4, "a"), (None, 4, "a"), (1, 2, "a")], SCHEMA)
    assert G.shortest_path(edges, 1, 4).first().path == [1, 2, 4]
    assert G.shortest_path(edges, 4, 4).first().path == [4]
    assert sorted(map(tuple, G.neighbors(edges, 4, 5).collect())) == [(1, 2), (2, 1), (3, 1)]
    assert G.neighbors(edges.limit(0), 1, 3).count() == 0


def test_nodes_and_edges(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, None, 5)], "k int, name string, n int")
    nodes = G.create_nodes(rows, "thing", "k", "name", "n")
    assert sorted((r.id, r.label, str(r.props)) for r in nodes.collect()) == [(1, "thing", "{'name': 'x'}"), (2, "thing", "{'n': '5'}")]
    links = spark.createDataFrame([(1, 2), (2, 9)], "a int, b int")
    assert [tuple(r) for r in G.create_edges(links, nodes, "to", "a", "b").collect()] == [(1, 2, "to")]
