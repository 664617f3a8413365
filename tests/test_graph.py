"""Graph operators on graphs drawn by hand."""

import pytest

from loomstone.operators import graph as G


@pytest.fixture
def edges(spark):
    return lambda *pairs: spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


def as_dict(df, key="id"):
    return {r[key]: tuple(r[c] for c in df.columns if c != key) for r in df.collect()}


def test_components_of_two_rings(edges):
    found = as_dict(G.strong_components(edges("ab", "bc", "ca", "cd", "de", "ed", "ef")))
    assert found == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 2), "e": ("d", 2), "f": ("f", 1)}


def test_betweenness_of_a_path(edges):
    found = as_dict(G.betweenness(edges("ab", "bc", "cd")))
    assert found["b"][0] == pytest.approx(2 * 2 / 6) and found["c"][0] == pytest.approx(2 * 2 / 6)
    assert found["a"][0] == 0 and found["d"][0] == 0


def test_betweenness_counts_equal_paths(edges):
    found = as_dict(G.betweenness(edges("ab", "ac", "bd", "cd")))
    assert found["b"][0] == pytest.approx(0.5 * 2 / 6) and found["c"][0] == pytest.approx(0.5 * 2 / 6)


def test_betweenness_refuses_a_large_graph(edges):
    with pytest.raises(ValueError):
        G.betweenness(edges("ab", "bc"), most_edges=1)


def test_communities_of_two_triangles(edges):
    found = as_dict(G.communities(edges("ab", "bc", "ca", "de", "ef", "fd", "cd"), levels=1))
    assert found["a"] == found["b"] == found["c"] != found["d"] == found["e"] == found["f"]


def test_communities_of_a_graph_too_large_for_a_task(edges):
    found = as_dict(G.communities(edges("ab", "bc", "ca", "de", "ef", "fd", "cd"), most_edges=1))
    assert found["a"] == found["b"] == found["c"] == ("a",) != found["d"] == found["e"] == found["f"]


def test_searches_make_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return (x, x + 1)

    chain = spark.createDataFrame(spark.sparkContext.parallelize(range(8), 1).map(counted), "src long, dst long")
    assert G.reach(chain, spark.createDataFrame([(2,)], "id long"), 5).count() == 6
    assert made.value == 8
    assert G.shortest_path(chain, 1, 5).first()["path"] == [1, 2, 3, 4, 5]
    assert made.value == 16


def test_pagerank_keeps_what_sinks_hold(edges):
    ranks = {k: v[0] for k, v in as_dict(G.pagerank(edges("ab", "aa", "ab"))).items()}
    assert ranks == {"a": pytest.approx(0.075), "b": pytest.approx(0.075 + 0.85 * 0.075)}


def test_reach_leaves_the_start_out_on_a_cycle(edges, spark):
    found = G.reach(edges("ab", "ba", "bc"), spark.createDataFrame([("a",)], "id string"), 5, keep_start=False)
    assert {(r["id"], r["depth"]) for r in found.collect()} == {("b", 1), ("c", 2)}


def test_shortest_path(edges):
    e = edges("ab", "bd", "ac", "cd", "de")
    assert G.shortest_path(e, "a", "e").first()["path"] == ["a", "b", "d", "e"]
    assert G.shortest_path(e, "e", "a").count() == 0


def test_cycles_once_each(edges):
    found = {tuple(r[0]) for r in G.cycles(edges("ab", "ba", "bc", "ca", "aa"), 3).collect()}
    assert found == {("a", "b"), ("a", "b", "c")}


def test_spread_takes_the_best_path(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.9), ("c", "b", 0.9), ("b", "d", 1.0)], "src string, dst string, w double")
    found = G.spread(e, spark.createDataFrame([("a",)], "id string"), lambda v, w: v * w, 4, 0.01)
    assert {r["id"]: round(r["value"], 4) for r in found.collect()} == {"b": 0.81, "c": 0.9, "d": 0.81}


def test_closeness(edges):
    found = as_dict(G.closeness(edges("ab", "bc"), 5))
    assert found["a"][0] == pytest.approx(2 / 3) and found["c"][0] == 0


def test_d_separation():
    chain, collider = [("a", "b"), ("b", "c")], [("a", "b"), ("c", "b"), ("b", "d")]
    assert not G.d_separated(chain, "a", "c", set()) and G.d_separated(chain, "a", "c", {"b"})
    assert G.d_separated(collider, "a", "c", set()) and not G.d_separated(collider, "a", "c", {"d"})


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert G.strong_components(none).count() == 0 and G.pagerank(none).count() == 0 and G.degrees(none).count() == 0
    assert G.graph_summary(none).first()["nodes"] == 0


def test_knowledge_edges_first_builder_wins(spark):
    s = "src string, dst string, kind string, weight double, confidence double"
    a, b = spark.createDataFrame([("a", "b", "x", 0.5, 0.1)], s), spark.createDataFrame([("a", "b", "x", 0.9, 0.9), ("b", "c", "x", 0.05, 1.0)], s)
    assert [tuple(r) for r in G.knowledge_edges([a, b]).collect()] == [("a", "b", "x", 0.5, 0.1)]


def test_degrees_roles(edges):
    found = as_dict(G.degrees(edges("ab", "bc", "dd")))
    assert found == {"a": (0, 1, "root"), "b": (1, 1, "inner"), "c": (1, 0, "leaf"), "d": (0, 0, "isolated")}


def test_betweenness_by_joins_is_the_same_without_a_limit(spark):
    import random

    rng = random.Random(2)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(40)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    want = {r["id"]: pytest.approx(r["betweenness"]) for r in G.betweenness(e).collect()}
    assert any(v != 0 for v in want.values()) and {r["id"]: r["betweenness"] for r in G.betweenness_joins(e).collect()} == want


def test_betweenness_query_holds_no_whole_graph(spark, sf, monkeypatch):
    from loomstone.plans import registry
    from loomstone.tables import Tables

    registry.queries()
    monkeypatch.setattr(G, "betweenness", None)  # refuses over 2,000,000 edges
    assert registry.PLANS["betweenness"](Tables(spark, sf)).count() > 60


def test_eigenvector_query_goes_on_until_scores_settle(spark, sf, monkeypatch):
    from loomstone.plans import registry
    from loomstone.tables import Tables

    registry.queries()
    monkeypatch.setattr(G, "eigenvector", lambda edges, rounds=100, tolerance=1e-6: (rounds, tolerance))
    assert registry.PLANS["eigenvector_centrality"](Tables(spark, sf)) == (100, 1e-6)


@pytest.mark.parametrize("most", [0, 25, 500_000])
def test_betweenness_by_blocks_and_by_levels_is_the_same(spark, monkeypatch, most):
    import random

    rng = random.Random(6)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(40)} | {(k, k // 2) for k in range(20, 80)}
    pairs = {(f"n{a:02}", f"n{b:02}") for a, b in pairs}
    e = spark.createDataFrame(sorted(pairs), "src string, dst string")
    want = {r["id"]: pytest.approx(r["betweenness"]) for r in G.betweenness(e).collect()}
    monkeypatch.setattr(G, "BLOCK_BITS", 2)
    monkeypatch.setattr(G, "BLOCK_ROWS", most)
    by_level, called = G._dependencies_by_level, []
    monkeypatch.setattr(G, "_dependencies_by_level", lambda e, sources: called.append(sources.count()) or by_level(e, sources))
    assert {r["id"]: r["betweenness"] for r in G.betweenness_joins(e).collect()} == want
    assert called == [] if most == 500_000 else 0 < called[0] <= len(want) and (called[0] == len(want)) == (most == 0)


def test_betweenness_query_makes_no_row_a_source_and_node(spark, sf, monkeypatch):
    from loomstone.plans import registry
    from loomstone.tables import Tables

    registry.queries()
    monkeypatch.setattr(G, "_dependencies_by_level", None)
    assert registry.PLANS["betweenness"](Tables(spark, sf)).count() > 60
