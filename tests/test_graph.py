"""Graphs, PageRank, walks, expansion, conflation."""

import numpy as np
import pytest

from relweave.operators import graph


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_two_nodes(spark):
    e = graph.undirected(edges(spark, [("A", "B", 1.0)]))
    seeds = spark.createDataFrame([(1, "A", 1.0)], "query bigint, node string, weight double")
    x = {r.node: r.score for r in graph.personalised_pagerank(e, seeds, 0.5, 60, tolerance=1e-12).collect()}
    assert x["A"] == pytest.approx(2 / 3) and x["B"] == pytest.approx(1 / 3)


def test_dead_ends_keep_the_mass(spark):
    e = edges(spark, [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0)])
    seeds = spark.createDataFrame([(1, "a", 0.5), (1, "lonely", 0.5), (2, "c", 1.0)], "query bigint, node string, weight double")
    rows = graph.personalised_pagerank(e, seeds, 0.5, 12).collect()
    for q in (1, 2):
        assert sum(r.score for r in rows if r.query == q) == pytest.approx(1)
    # dense check of query 1
    names = ["a", "b", "c", "lonely"]
    p = np.zeros((4, 4))
    p[0, 1], p[0, 2], p[1, 2] = 2 / 3, 1 / 3, 1
    r = np.array([0.5, 0, 0, 0.5])
    p[2], p[3] = r, r
    x = r.copy()
    for _ in range(12):
        x = 0.5 * r + 0.5 * x @ p
    got = {g.node: g.score for g in rows if g.query == 1}
    assert [got.get(n, 0.0) for n in names] == pytest.approx(list(x))


def test_assembly_priorities(spark):
    fact, passage, synonym = edges(spark, [("a", "b", 3.0), ("b", "a", 3.0), ("a", "a", 1.0)]), edges(spark, [("p", "a", 1.0)]), edges(spark, [("a", "b", 0.9), ("a", "ghost", 0.8)])
    nodes = spark.createDataFrame([("a",), ("b",), ("p",)], "node string")
    out = {(r.src, r.dst): r.weight for r in graph.assemble(fact, passage, synonym, nodes).collect()}
    assert out == {("a", "b"): 0.9, ("b", "a"): 3.0, ("p", "a"): 1.0}


def test_fact_entity_counts_twice(spark):
    t = spark.createDataFrame([("x", "is", "x"), ("x", "has", "y")], "s string, p string, o string")
    facts = spark.createDataFrame([(0, "x is x"), (1, "x has y")], "idx bigint, token string")
    v = spark.createDataFrame([(0, "x"), (1, "y")], "idx bigint, token string")
    assert sorted(map(tuple, graph.fact_entity_graph(t, facts, v).collect())) == [(0, 0, 2.0), (1, 0, 1.0), (1, 1, 1.0)]
    assert sorted(map(tuple, graph.entity_graph(t, v).collect())) == [(0, 0, 1.0), (0, 1, 1.0)]


def test_seed_weights_compound(spark):
    q = spark.createDataFrame([(0, 0, 1.0)], "row_idx bigint, col_idx bigint, score double")
    ends = spark.createDataFrame([(0, 0, 10), (0, 1, 11)], "row_idx bigint, side int, entity bigint")
    labels = spark.createDataFrame([(0, 10, 1.0), (1, 10, 1.0), (0, 11, 1.0), (1, 11, 1.0), (2, 11, 1.0), (3, 11, 1.0)], "row_idx bigint, col_idx bigint, score double")
    plain = {r.node: r.weight for r in graph.seed_weights(q, ends, labels).collect()}
    both = {r.node: r.weight for r in graph.seed_weights(q, ends, labels, compound=True).collect()}
    assert plain == {10: 0.5, 11: 0.25} and both == {10: 0.5, 11: 0.125}


def test_walks_agree_with_expectation(spark):
    e = graph.undirected(edges(spark, [("a", "b", 1.0), ("b", "c", 3.0)]))
    starts = spark.createDataFrame([("a",)], "node string")
    seen = {r.node: r.score for r in graph.random_walks(e, starts, 0.5, 30, 200, 4).collect()}
    want = {r.node: r.score for r in graph.walk_expectation(e, starts, 0.5, 25).collect()}
    assert sum(seen.values()) == 30 * 200
    for n in want:
        assert seen[n] / sum(seen.values()) == pytest.approx(want[n] / sum(want.values()), abs=0.05)


def test_a_hub_is_not_expanded_per_walker(spark):
    e = edges(spark, [("hub", f"n{k}", 1000.0 if k == 7 else 1.0) for k in range(300)] + [("n7", "hub", 1.0)])
    rows = graph.walk_ranges(e).filter("src = 'hub'").collect()
    assert len(rows) < 2 * 300 and {r.dst for r in rows} == {f"n{k}" for k in range(300)}
    for u in np.random.default_rng(3).random(200):
        hit = [r.dst for r in rows if r.low <= u < r.high]
        assert len(set(hit)) == 1  # an edge may reach into several bins
        assert [r.dst for r in rows if r.bin == int(u * 300) and r.low <= u < r.high] == hit[:1]
    seen = {r.node: r.score for r in graph.random_walks(e, spark.createDataFrame([("hub",)], "node string"), 0.5, 12, 300, 4).collect()}
    assert sum(seen.values()) == 12 * 300 and seen["n7"] / (sum(seen.values()) - seen["hub"]) == pytest.approx(1000 / 1299, abs=0.05)


def test_walks_are_registered_over_the_supply_graph(spark, monkeypatch):
    from relweave.plans import graphs

    walked = []
    walks = graph.random_walks

    def short(edges, starts, restart=0.5, length=400, walkers=1, seed=1):
        walked.append((edges.count(), starts.distinct().count(), length))
        return walks(edges, starts, restart, 3, walkers, seed)

    monkeypatch.setattr(graph, "random_walks", short)
    d = "/root/testdata/sf0.001"
    assert graphs.random_walk(spark, d).select("start").distinct().count() == 210
    assert graphs.node_rank_walk(spark, d).count() > 10
    assert walked == [(3810, 210, 400), (3810, 10, 100)]


def test_multi_hop(spark):
    r = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0)], "row_idx bigint, col_idx bigint, score double")
    assert graph.multi_hop(r).count() == 16 and graph.multi_hop(r).select("path").distinct().count() == 16
    with pytest.raises(Exception, match="more than 2 labels"):
        graph.multi_hop(r, 2).collect()


def test_beam(spark):
    step = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (2, 1, 0.9), (2, 3, 0.5), (3, 1, 0.7)], "row_idx bigint, col_idx bigint, score double")
    start = spark.createDataFrame([(0, 1, 1.0)], "row_idx bigint, col_idx bigint, score double")
    paths = {tuple(r.path): round(r.score, 6) for r in graph.beam_hops(start, step, 2, 2, 5).collect()}
    assert paths == {(1, 2, 3): 0.45}


def test_components_against_union_find(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(k, k + 1) for k in range(100, 130)]
    parent = {n: n for p in pairs for n in p} | {999: 999}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    df = spark.createDataFrame(pairs, "src bigint, dst bigint")
    nodes = spark.createDataFrame([(n,) for n in parent], "node bigint")
    assert {r.node: r.component for r in graph.components(df, nodes).collect()} == {n: find(n) for n in parent}


def test_conflation(spark):
    r = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 3, 1.0)], "row_idx bigint, col_idx bigint, score double")
    info = spark.createDataFrame([(1, "a", "Red-Car"), (2, "b", "red car "), (3, "c", "bus")], "idx bigint, identifier string, text string")
    assert sorted(map(tuple, graph.conflate_phrases(info, r).select("row_idx", "col_idx", "score").collect())) == [(0, 1, 3.0), (1, 3, 1.0)]
    sim = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.95), (3, 1, 0.2)], "row_idx bigint, col_idx bigint, score double")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node bigint")
    assert sorted(map(tuple, graph.conflate_similar(sim, r, nodes).select("row_idx", "col_idx", "score").collect())) == [(0, 1, 3.0), (1, 3, 1.0)]


def test_node_rank_walks_sum_to_one(spark):
    cells = lambda rows: spark.createDataFrame(rows, "row_idx bigint, col_idx bigint, score double")
    out = graph.node_rank_walks(cells([(0, 1, 1.0), (1, 1, 1.0), (1, 3, 3.0)]), cells([(1, 2, 1.0), (2, 1, 1.0), (3, 3, 1.0)]), 0.5, 12, 2).collect()
    for row in (0, 1):
        assert sum(r.score for r in out if r.row_idx == row) == pytest.approx(1)
    assert {r.col_idx for r in out if r.row_idx == 0} == {1, 2}
    assert next(r.score for r in out if (r.row_idx, r.col_idx) == (1, 3)) == pytest.approx(0.75)


def test_seed_nodes(spark):
    reset = spark.createDataFrame([(0, 5), (1, 6), (1, 7)], "row_idx bigint, col_idx bigint")
    columns = spark.range(50).withColumnRenamed("id", "node")
    out = {(r.row_idx, r.col_idx) for r in graph.seed_nodes(reset, columns, 8, 3).collect()}
    assert {(0, 5), (1, 6), (1, 7)} <= out
    for row, own in ((0, {5}), (1, {6, 7})):
        assert 8 <= len({c for r, c in out if r == row} | own) <= 8 + len(own)
    assert graph.seed_nodes(reset, columns, 0).count() == 3
    assert len({c for r, c in ((r.row_idx, r.col_idx) for r in graph.seed_nodes(reset, columns, 500, 3).collect()) if r == 0}) == 50


def test_node_rank_of_one_kind(spark):
    """On a graph of two kinds of nodes only the visits to the kept kind count."""
    edges = [(0, 10, 1.0), (1, 10, 1.0), (1, 11, 1.0)]
    forward = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "row_idx bigint, col_idx bigint, score double")
    reset = spark.createDataFrame([(7, 0, 1.0)], "row_idx bigint, col_idx bigint, score double")
    kept = spark.createDataFrame([(10,), (11,)], "node bigint")
    rows = graph.node_rank_walks(reset, forward, length=60, seed=2, num_seed_nodes=1, kept=kept).collect()
    assert {r.col_idx for r in rows} <= {10, 11} and abs(sum(r.score for r in rows) - 1) < 1e-9


def test_conflation_bounds_and_missing_phrases(spark):
    similar = spark.createDataFrame([(1, 2, 0.95), (1, 3, 0.9), (4, 5, 1.0), (6, 7, 0.5)], "row_idx bigint, col_idx bigint, score double")
    r = spark.createDataFrame([(0, c, 1.0) for c in range(1, 8)], "row_idx bigint, col_idx bigint, score double")
    columns = r.select(r.col_idx.alias("node"))
    names = lambda **k: {x.col_idx: x.score for x in graph.conflate_similar(similar, r, columns, 2, 0.6, **k).collect()}
    assert names() == {1: 3.0, 4: 2.0, 6: 1.0, 7: 1.0}
    assert names(most=0.99) == {1: 3.0, 4: 1.0, 5: 1.0, 6: 1.0, 7: 1.0}
    assert names(largest_difference=0.01) == {1: 2.0, 3: 1.0, 4: 2.0, 6: 1.0, 7: 1.0}
    info = spark.createDataFrame([(1, "a", "Red car"), (2, "b", "red car "), (3, "c", None), (4, "d", None), (5, "e", ""), (6, "f", "?!"), (7, "g", "x")], "idx bigint, identifier string, text string")
    assert {x.col_idx for x in graph.conflate_phrases(info, r).collect()} == {1, 3, 4, 5, 6, 7}


def test_pagerank_of_many_queries(spark, monkeypatch):
    """More queries than stand side by side, with different seeds."""
    monkeypatch.setattr(graph, "SIDE_BY_SIDE", 2)
    e = graph.undirected(spark.createDataFrame([(k, (k + 1) % 6, 1.0 + k) for k in range(6)], "src bigint, dst bigint, weight double"))
    seeds = spark.createDataFrame([(q, q, 1.0) for q in range(5)], "query bigint, node bigint, weight double")
    together = {(r.query, r.node): r.score for r in graph.personalised_pagerank(e, seeds, 0.5, 12).collect()}
    for q in range(5):
        alone = {(r.query, r.node): r.score for r in graph.personalised_pagerank(e, seeds.filter(f"query = {q}"), 0.5, 12).collect()}
        assert {k: round(v, 12) for k, v in together.items() if k[0] == q} == {k: round(v, 12) for k, v in alone.items()}


def test_choices_of_bounded_length(spark):
    r = spark.createDataFrame([(0, c, 1.0) for c in range(9)], "row_idx bigint, col_idx bigint, score double")
    paths = [tuple(x.path) for x in graph.multi_hop(r, hops=2).collect()]
    assert len(paths) == len(set(paths)) == 1 + 9 + 72


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_walks_are_the_same_either_way(spark, monkeypatch, kind):
    """Over a broadcast graph and by joins: the same draws give the same visits; node 3 has no way out."""
    rows = [(0, 1, 1.5), (1, 2, 1.0), (1, 0, 0.25), (2, 0, 2.0), (2, 3, 1.0), (1, 3, 0.0)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, weight double").selectExpr(f"CAST(src AS {kind}) AS src", f"CAST(dst AS {kind}) AS dst", "weight")
    starts = e.selectExpr("src AS node").union(e.selectExpr("dst AS node"))
    walks = lambda: sorted(map(tuple, graph.random_walks(e, starts, 0.3, 30, 2, 5).collect()))
    local = walks()
    monkeypatch.setattr(graph, "WALK_EDGES", 0)
    assert local == walks() and sum(r[2] for r in local) == 4 * 2 * 30


def test_draws_are_those_of_md5():
    import hashlib

    from relweave.functions.draws import draws

    one = lambda *parts: int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 16**12
    for starts in ([7, -12, 123456789], ["a", "дом", "x" * 60, ""]):
        u = draws(starts, [1, 2, 1, 4][: len(starts)], 120, 0.4, 3)
        for i, (s, w) in enumerate(zip(starts, [1, 2, 1, 4])):
            want = [one(3, s, w, k, 0) if one(3, s, w, k, 1) >= 0.4 else None for k in range(1, 120)]
            assert [None if np.isnan(x) else x for x in u[i]] == want


def test_rounds_of_a_large_graph_are_few(spark, monkeypatch):
    """A round for each step of the longest run without a restart, not for each step of the walk."""
    tables = []
    table = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: tables.append(1) or table(df))
    e = spark.createDataFrame([(k, (k + j) % 7, 1.0 + j) for k in range(7) for j in (1, 2)], "src bigint, dst bigint, weight double")
    walks = lambda: sorted(map(tuple, graph.random_walks(e, e.selectExpr("src AS node"), 0.5, 200, 1, 5).collect()))
    local = walks()
    tables.clear()
    monkeypatch.setattr(graph, "WALK_EDGES", 0)
    assert walks() == local and sum(r[2] for r in local) == 7 * 200
    assert len(tables) < 25


def test_undirected_computes_its_edges_once(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("c", "c", 1.0)], "src string, dst string, weight double").groupBy("src", "dst").max("weight").toDF("src", "dst", "weight")
    out = graph.undirected(e)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("a", "b", 3.0), ("b", "a", 3.0), ("c", "c", 2.0)]
