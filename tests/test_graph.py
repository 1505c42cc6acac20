import itertools
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempoloom import queries
from tempoloom.operators import centrality, filters, graph, knn, ranking

M = "name string, type string, description string, source_doc_id string, chunk_id string, date string, doc_ord long, ord long"
R = "source string, target string, keywords string, description string, evidence string, source_doc_id string, chunk_id string, date string, doc_ord long, ord long"


@pytest.fixture(scope="module")
def built(spark):
    m = [("Apple", "COMPANY", "makes phones", "d1", "c1", "2024-01", 1, 1), ("Apple", "PRODUCT", "again", "d2", "c2", "2024-01", 2, 5), ("apple", "COMPANY", "lower", "d2", "c2", "2024-01", 2, 6), ("Apple", "COMPANY", "later", "d3", "c3", "2024-04", 3, 9), ("Apple", "COMPANY", "far", "d4", "c4", "2024-08", 4, 12), ("Odd", "X", None, "d4", "c4", None, 4, 13), ("Odd", "X", "u", "d5", "c5", "", 5, 14), ("Bad", "X", "u", "d5", "c5", "2024-13", 5, 15), ("Pear", "COMPANY", "p", "d1", "c1", "2024-01", 1, 2)]
    r = [("Apple", "Pear", "rival", "one", "e1", "d1", "c1", "2024-01", 1, 1), ("Apple", "Pear", "rival", "two", "e2", "d2", "c2", "2024-01", 2, 2), ("Apple", "Pear", "buys", None, None, "d3", "c3", "2024-01", 3, 3), ("Apple", "Nobody", "x", "y", "z", "d1", "c1", "2024-01", 1, 4), ("Apple", "Pear", "x", "y", "z", "d1", "c1", None, 1, 5)]
    mentions, relations = spark.createDataFrame(m, M), spark.createDataFrame(r, R)
    nodes = graph.merge_nodes(mentions)
    return nodes, relations, graph.merge_edges(graph.accepted_relations(relations, nodes))


def test_merges(built):
    nodes, relations, edges = built
    n = {r.node_id: r for r in nodes.collect()}
    a = n["Apple__2024-01"]
    assert (a.type, a.description, a.source_doc_ids, a.chunk_id) == ("COMPANY", "makes phones\n---\nagain", ["d1", "d2"], "c1")
    assert n["Odd__TIME_UNKNOWN"].source_doc_ids == ["d4", "d5"] and n["Odd__TIME_UNKNOWN"].month_idx is None and n["Bad__2024-13"].month_idx is None
    e = edges.collect()
    assert len(e) == 1 and e[0].relation_keywords == ["rival", "buys"] and e[0].description == "rival: one\nrival: two\nbuys: " and e[0].evidence == "e1\ne2"
    assert {r.target for r in graph.rejected_relations(relations, nodes).collect()} == {"Nobody", "Pear"}


def test_links(built):
    nodes, _, edges = built
    links = graph.temporal_links(nodes, edges)
    got = {(r.src, r.dst): r.time_similarity for r in links.collect()}
    assert got == {("Apple__2024-01", "apple__2024-01"): 1.0, ("Apple__2024-01", "Apple__2024-04"): pytest.approx(0.4), ("apple__2024-01", "Apple__2024-04"): pytest.approx(0.4)}
    assert graph.temporal_links(nodes, edges.unionByName(links)).count() == 0
    all_ = edges.unionByName(links)
    assert [r.node_id for r in graph.timeline(nodes, "APPLE").collect()] == ["Apple__2024-01", "apple__2024-01", "Apple__2024-04", "Apple__2024-08"]
    assert {r.node_id for r in graph.neighbors(nodes, all_, "Apple__2024-01", ["rival"]).collect()} == {"Pear__2024-01"}
    rules = {(r.rule, r.subject) for r in graph.validation(nodes, all_).collect()}
    assert ("isolated", "Apple__2024-08") in rules and ("no_time", "Odd__TIME_UNKNOWN") in rules
    assert graph.is_valid(graph.validation(nodes, all_)).first().is_valid
    assert filters.edges_in(all_, ["2024-02"]).count() == 3 and filters.edges_in(all_, ["2024-02"], "expanded", "within_range").count() == 1
    assert filters.nodes_in(nodes, ["2024-02"]).count() == 0 and filters.nodes_in(nodes, ["2024-02"], "expanded").count() == 3


def random_graph(spark, n=14, m=40, seed=1):
    g = random.Random(seed)
    e = [(f"n{g.randrange(n):02d}", f"n{g.randrange(n):02d}") for _ in range(m)]
    return spark.createDataFrame([(f"n{i:02d}",) for i in range(n)], "node_id string"), spark.createDataFrame(e, "src string, dst string"), [f"n{i:02d}" for i in range(n)], e


def brute_betweenness(ids, e):
    out = defaultdict(set)
    for a, b in e:
        if a != b:
            out[a].add(b)
    node, edge = defaultdict(float), defaultdict(float)
    for s in ids:
        dist, q = {s: 0}, deque([s])
        while q:
            v = q.popleft()
            for x in out[v]:
                if x not in dist:
                    dist[x] = dist[v] + 1
                    q.append(x)
        for t in ids:
            if t == s or t not in dist:
                continue
            paths = [[t]]
            while paths and paths[0][0] != s:
                paths = [[v, *p] for p in paths for v in ids if p[0] in out[v] and dist.get(v, -9) == dist[p[0]] - 1]
            for p in paths:
                for v in p[1:-1]:
                    node[v] += 1 / len(paths)
                for a, b in itertools.pairwise(p):
                    edge[a, b] += 1 / len(paths)
    n = len(ids)
    return {i: node[i] / ((n - 1) * (n - 2)) for i in ids}, {k: v / (n * (n - 1)) for k, v in edge.items()}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_betweenness_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(centrality, "BROADCAST_EDGES", limit)
    nodes, edges, ids, e = random_graph(spark, 8, 14) if not limit else random_graph(spark)
    want_n, want_e = brute_betweenness(ids, e)
    a, b = centrality.betweenness(nodes, edges)
    assert {r.node_id: pytest.approx(r.betweenness) for r in a.collect()} == want_n
    assert {(r.src, r.dst): pytest.approx(r.betweenness) for r in b.collect() if r.betweenness} == want_e


def test_pagerank_against_brute_force(spark):
    nodes, edges, ids, e = random_graph(spark)
    r = {i: 1 / len(ids) for i in ids}
    for _ in range(15):
        lost = sum(r[i] for i in ids if not any(a == i for a, _ in e))
        new = {i: 0.15 / len(ids) + 0.85 * lost / len(ids) for i in ids}
        for a, b in e:
            new[b] += 0.85 * r[a] / sum(x == a for x, _ in e)
        r = new
    got = {x.node_id: x.pagerank for x in centrality.pagerank(nodes, edges, iterations=15, tolerance=0).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in r.items()} and sum(got.values()) == pytest.approx(1)
    assert centrality.pagerank(nodes.limit(0), edges, iterations=2).count() == 0


def test_components_and_degree(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node_id string")
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("e", "d"), ("e", "d")], "src string, dst string")
    assert {r.node_id: r.component for r in centrality.components(nodes, edges).collect()} == dict(zip("abcdef", "aaaddf"))
    assert tuple(centrality.connectivity(nodes, edges).first()) == (3, False)
    assert {r.node_id: r.degree for r in centrality.degree(nodes, edges).collect()}["e"] == pytest.approx(0.4)


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", 2.0, 1), ("c", None, 1)], "k string, score double, o int")
    assert [r.k for r in ranking.top(df, 2).collect()] == ["a", "b"]
    assert {r.k: r.score for r in ranking.keep_first(df, ["k"], ["o"]).collect()} == {"a": 1.0, "b": 2.0, "c": None}
    assert ranking.beam(df, df.limit(1), 2, "score", "k").count() == 2
    lines = spark.createDataFrame([(1, 4), (2, 5), (3, 3)], "i int, tokens int")
    assert [r.i for r in ranking.within_budget(lines, 10, "tokens", ["i"]).collect()] == [1, 2]


def test_knn(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "y"), (3, None, "x"), (4, [1.0, 0.0], None), (5, [0.0, 0.0], "x")], "vec_id long, embedding array<float>, label string")
    assert [(r.vec_id, r.score) for r in knn.search(v, [2.0, 0.0], 3).collect()] == [(1, 1.0), (4, 1.0), (2, 0.0)]
    assert [r.vec_id for r in knn.search(v, [2.0, 0.0], 9, where={"label": "x"}).collect()] == [1, 5]
    assert knn.checked(v, 2).count() == 4
    with pytest.raises(Exception):
        knn.checked(v, 3).collect()
    assert knn.stats(v).first().total_vectors == 4
    up = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "vec_id long, t string, o int")
    assert knn.latest(up, "vec_id", "o").first().t == "new"
    assert v.filter(filters.equal_to({"label": "x", "vec_id": 1})).count() == 1 and v.filter(filters.equal_to(None)).count() == 5 and F is not None


def test_every_row_finds_nine_of_ten_neighbors(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in queries.t(spark, sf, "embeddings").collect()}
    want = {i: sorted((round(float(((x - y) ** 2).sum()), 9), j) for j, y in v.items() if j != i)[:10] for i, x in v.items()}
    got = defaultdict(set)
    for r in queries.QUERIES["knn_inverted_lists"](spark, sf).collect():
        got[r.vec_id].add(r.neighbor)
    assert set(got) == set(v) and all(len(x) == 10 for x in got.values())
    assert sum(len(got[i] & {j for _, j in w}) for i, w in want.items()) >= 0.9 * 10 * len(v)
    monkeypatch.setattr(knn, "BLOCK", 40)  # every list and several blocks: exact
    listed, centroids = knn.inverted_lists(queries.t(spark, sf, "embeddings"), 5)
    exact = defaultdict(list)
    for r in knn.neighbors(listed, centroids, 10, 5).orderBy("vec_id", "place").collect():
        exact[r.vec_id].append((round(r.score, 9), r.neighbor))
    assert exact == want


def test_endpoints_are_looked_up_among_all_mentions(spark, built):
    nodes, relations, _ = built
    late = nodes.withColumn("first_doc_ord", F.when(F.col("name") == "Pear", F.lit(2)).otherwise(F.col("first_doc_ord")))
    assert sorted(r.ord for r in graph.accepted_relations(relations, late).collect()) == [1, 2, 3]
    assert sorted(r.ord for r in graph.accepted_relations(relations, late, strict=True).collect()) == [2, 3]
    assert sorted(r.ord for r in graph.rejected_relations(relations, nodes).collect()) == [4, 5]
    found = {(r.rule, r.subject) for r in graph.validation(nodes, graph.merge_edges(relations)).collect()}
    assert ("missing_node", "Nobody__2024-01") in found and ("missing_node", "Apple__2024-01") not in found
    sf = "/root/testdata/sf0.001"
    assert sum(r.n for r in queries.QUERIES["relation_endpoint_check_all"](spark, sf).collect()) == queries.t(spark, sf, "orders").count()
    assert queries.QUERIES["rejected_relations_all"](spark, sf).count() == 0


def test_chunks_are_looked_up_in_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.chunk_id: r.content.lower() for r in queries.dated_chunks(spark, sf).collect()}
    best = sorted(text, key=lambda c: (-sum(w.lower() in text[c] for w in queries.WORDS), c))[:10]
    got = queries.QUERIES["chunk_lookup_found"](spark, sf).collect()
    assert {r.chunk_id for r in got if r.is_primary} == set(best) and sum(not r.is_primary for r in got) == 3
    lines = sorted(queries.QUERIES["chunk_budget_context_found"](spark, sf).collect(), key=lambda r: r.running)
    assert [r.chunk_id for r in lines] == sorted(best)[: len(lines)] and 4 < len(lines) <= 10 and lines[-1].running <= 1200


def test_registered_centrality_has_production_parameters(spark, monkeypatch):
    nodes, edges, ids, e = random_graph(spark)
    monkeypatch.setattr(queries, "nodes", lambda *_: nodes)
    monkeypatch.setattr(queries, "edges", lambda *_: edges)
    r = {i: 1 / len(ids) for i in ids}
    for _ in range(200):
        lost = sum(r[i] for i in ids if not any(a == i for a, _ in e))
        new = {i: 0.15 / len(ids) + 0.85 * lost / len(ids) for i in ids}
        for a, b in e:
            new[b] += 0.85 * r[a] / sum(x == a for x, _ in e)
        r = new
    got = {x.node_id: x.pagerank for x in queries.QUERIES["pagerank_all_rounds"](spark, "").collect()}
    assert got == {k: pytest.approx(v, abs=1e-4) for k, v in r.items()}

    class Seen(Exception):
        pass

    def combined(_nodes, _edges, *args):
        raise Seen(*args)

    monkeypatch.setattr(centrality, "combined", combined)
    monkeypatch.setattr(queries, "with_vectors", lambda df, *_: df)
    with pytest.raises(Seen) as seen:
        queries._full(spark, "")
    assert seen.value.args == (100, 50, 50)


def test_every_node_has_its_component(spark, monkeypatch):
    nodes, edges, ids, e = random_graph(spark, 30, 18, 4)
    monkeypatch.setattr(queries, "nodes", lambda *_: nodes)
    monkeypatch.setattr(queries, "edges", lambda *_: edges)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in e:
        low, high = sorted((find(a), find(b)))
        top[high] = low
    got = {r.node_id: r.component for r in queries.QUERIES["components_of_all_nodes"](spark, "").collect()}
    assert got == {i: find(i) for i in ids} and len(set(got.values())) > 1


def test_pair_similarity_makes_no_pairs_and_equals_the_join(spark):
    from tempoloom.functions import vectorfn

    g = np.random.default_rng(4)
    odd = [(1, 0, [0.0, 0.0]), (2, 0, None), (3, 0, [1.0, None]), (4, 0, [1.0, 2.0, 3.0]), (5, 0, [2.0, 2.0, 1.0]), (6, 9, [1.0, 1.0]), (7, 8, None), (8, 8, [1.0, 1.0]), (9, 7, []), (10, 7, [])]
    rows = odd + [(None, 0, [1.0, 1.0]), (11, None, [1.0, 1.0])] + [(int(g.integers(20, 60)), int(g.integers(0, 3)), g.normal(size=2).tolist()) for _ in range(120)]
    a = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    b = a.toDF("other", "label", "e2")
    want = a.join(b, "label").filter("vec_id < other").groupBy("label").agg(F.count("*").alias("pairs"), F.avg(vectorfn.cosine(F.col("embedding"), F.col("e2"))).alias("mean"))
    got = knn.pair_similarity(a, "label")
    rows = lambda n: knn.pair_similarity(spark.range(n).selectExpr("id as vec_id", "1 as label", "array(1f, 2f) as embedding"), "label").first()
    assert tuple(rows(1_000_000)) == (1, 499_999_500_000, pytest.approx(1.0))  # no pairs are made
    assert {r.label: (r.pairs, pytest.approx(r.mean) if r.mean is not None else None) for r in want.collect()} == {r.label: (r.pairs, r.mean) for r in got.collect()}
