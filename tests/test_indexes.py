"""Vector and trigram indexes against full scans, the graph's growth against a plain loop, global order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, ordering, trigram_index, vector_index


def grouped(seed, n=400, width=16):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(6, width)) * 3
    x = middle[np.minimum(5, r.exponential(1.2, n).astype(int))] + r.normal(size=(n, width)) * 0.4
    x[50:80] = x[7]
    return x


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], f"{name} long, vector array<double>")


@pytest.mark.parametrize(("k", "cells"), [(1, None), (12, None), (40, 3), (500, 7)])
def test_nearest_equals_a_full_scan(spark, monkeypatch, k, cells):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    monkeypatch.setattr(vector_index, "QUERIES", 5)
    x, q = np.split(grouped(1, 423), [400])
    bad = spark.createDataFrame([(900, None), (901, [1.0]), (902, [float("nan")] * 16), (None, [0.0] * 16)], "id long, vector array<double>")
    index = vector_index.VectorIndex.build(frame(spark, x).union(bad), 16, cells)
    got = index.nearest(frame(spark, q, "q").union(bad), k).collect()
    away = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    for i, row in enumerate(away):
        order = np.lexsort((np.arange(len(x)), row))[:k]
        mine = sorted((r.rank, r.id) for r in got if r.q == i)
        assert [j for _, j in mine] == order.tolist()
    if k == 1 and cells is None:
        assert np.mean([r.scored for r in got if r.q < 23]) < 0.5 * len(x), "cells are skipped"


def test_within_and_similar_equal_a_full_scan(spark):
    x, q = np.split(grouped(3, 230), [200])
    away = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    got = {(r.q, r.id) for r in vector_index.VectorIndex.build(frame(spark, x), 16).within(frame(spark, q, "q"), 2.5).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(away <= 2.5))} and got
    zero = spark.createDataFrame([(999, [0.0] * 16)], "id long, vector array<double>")
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    got = {(r.q, r.id) for r in vector_index.similar(frame(spark, x).union(zero), frame(spark, q, "q"), 0.9, 16).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(cos >= 0.9))} and got


def test_indexes_without_rows(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    some = frame(spark, grouped(5)[:4])
    assert vector_index.VectorIndex.build(none, 16).nearest(some.withColumnRenamed("id", "q"), 3).count() == 0
    assert vector_index.VectorIndex.build(some, 16).nearest(none.withColumnRenamed("id", "q"), 3).count() == 0
    texts = spark.createDataFrame([], "key long, text string")
    assert trigram_index.TrigramIndex.build(texts).top(spark.createDataFrame([(1, "abc")], "q long, text string"), 3).count() == 0


def plain_trigrams(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


@pytest.mark.parametrize(("k", "lists"), [(1, 4096), (5, 4), (30, 4096)])
def test_trigram_top_equals_a_full_scan(spark, monkeypatch, k, lists):
    monkeypatch.setattr(trigram_index, "LIST", lists)
    r = random.Random(k)
    word = lambda: "".join(r.choices("abcdé", k=r.randrange(1, 7)))
    texts = [(i, " ".join(word() for _ in range(r.randrange(0, 25)))) for i in range(150)] + [(200, None), (201, "!?"), (202, "abc abc"), (203, "abc")]
    queries = [(i, " ".join(word() for _ in range(r.randrange(1, 12)))) for i in range(12)] + [(50, None), (51, "zzz"), (52, "ABC"), (53, texts[3][1])]
    index = trigram_index.TrigramIndex.build(spark.createDataFrame(texts, "key long, text string"))
    got = index.top(spark.createDataFrame(queries, "q long, text string"), k).collect()
    sets = {i: plain_trigrams(t) for i, t in texts}
    for q, text in queries:
        own = plain_trigrams(text)
        scores = sorted((-len(own & s) / max(1, len(own | s)), i) for i, s in sets.items() if own & s)[:k]
        mine = sorted((x.rank, x.key, x.similarity) for x in got if x.q == q)
        assert [(i, pytest.approx(-s)) for s, i in scores] == [(i, s) for _, i, s in mine]


def test_trigram_pairs(spark):
    texts = [(1, "alpha beta"), (2, "beta alpha"), (3, "alphabet"), (4, "xyz"), (5, "")]
    got = {(r.a_id, r.b_id): r.similarity for r in trigram_index.TrigramIndex.build(spark.createDataFrame(texts, "key long, text string")).pairs().collect()}
    sets = {i: plain_trigrams(t) for i, t in texts}
    assert got == {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}


def grow(nodes, edges, relations, vectors, threshold):
    """The rule itself: one relation after the other."""
    def cos(a, b):
        a, b = np.array(a), np.array(b)
        return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))

    nodes, edges, top = {i: [n, v] for i, n, v in nodes}, set(edges), max(i for i, _, _ in nodes)
    for _, source, relation, target in sorted(relations):
        seen = []
        for name in (source, target):
            v = vectors.get(name)
            near = sorted(((cos(v, w), i) for i, (_, w) in nodes.items() if w is not None), reverse=True) if v else []
            seen.append(near[0][1] if near and near[0][0] >= threshold else None)
        for k, name in enumerate((source, target)):
            if seen[k] is None:
                old = [i for i, (n, _) in nodes.items() if n == name]
                if old:
                    seen[k] = min(old)
                else:
                    top += 1
                    seen[k] = top
                nodes[seen[k]] = [name, vectors.get(name)]
        edges.add((seen[0], relation, seen[1]))
    return {i: n for i, (n, _) in nodes.items()}, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_upsert_equals_the_loop(spark, seed):
    r = random.Random(seed)
    x = grouped(seed + 10, 90, 8)
    vectors = {f"e{i}": [float(c) for c in x[i]] for i in range(90) if i % 13}
    nodes = [(i, f"e{i}", vectors.get(f"e{i}") if i % 3 else None) for i in range(0, 20, 2)]
    relations = [(n, f"e{r.randrange(90)}", r.choice(["USES", "KNOWS"]), f"e{r.randrange(90)}") for n in range(80)]
    relations = [x for x in relations if x[1] != x[3]]
    edges = [(0, "USES", 2), (4, "KNOWS", 2)]
    got_nodes, got_edges = graph.upsert(
        spark.createDataFrame(nodes, "id long, name string, embedding array<double>"), spark.createDataFrame(edges, "source_id long, relationship string, destination_id long"),
        spark.createDataFrame(relations, "n long, source string, relationship string, destination string"), spark.createDataFrame(list(vectors.items()), "name string, vector array<double>"), 0.97, 8,
    )
    want_nodes, want_edges = grow(nodes, edges, relations, vectors, 0.97)
    assert {r.id: r.name for r in got_nodes.collect()} == want_nodes
    assert {tuple(r)[:3] for r in got_edges.collect()} == want_edges and len(want_nodes) > len(nodes)


def test_seeds_need_a_vector(spark):
    nodes = spark.createDataFrame([(1, "nebula", [1.0]), (2, "nebula two", None), (3, "star", [1.0])], "id long, name string, embedding array<double>")
    assert [r.id for r in graph.by_query(nodes, ["nebula"]).collect()] == [1]
    assert [r.id for r in graph.by_query(nodes, ["quasars"]).collect()] == [3, 1]


def test_many_query_vectors(spark):
    x = grouped(20, 150)
    nodes, queries = frame(spark, x).withColumnRenamed("vector", "embedding"), frame(spark, x[:100], "q")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: s for i, s in enumerate((unit[:100] @ unit.T).max(0)) if s >= 0.99}
    got = {r.id: r.score for r in graph.similar_nodes(nodes, queries, 0.99, 16).collect()}
    assert got == pytest.approx(want) and len(want) > 100
    few = {r.id for r in graph.similar_nodes(nodes, queries.where("q = 60"), 0.5, 16, 2).collect()}
    assert few == {79, 78}, "the newest of equals"


def test_ranks_over_ranges(spark):
    r = random.Random(4)
    rows = [(i, r.choice("abc")) for i in range(500)]
    got = ordering.ranked(spark.createDataFrame(rows, "id long, name string").repartition(7), F.desc("name"), "id").collect()
    want = sorted(rows, key=lambda x: (-ord(x[1]), x[0]))
    assert [x.id for x in sorted(got, key=lambda x: x["rank"])] == [i for i, _ in want] and sorted(x["rank"] for x in got) == list(range(1, 501))
    page = ordering.page(spark.createDataFrame(rows, "id long, name string"), "name", "id", size=10, number=50).collect()
    assert sorted(x["rank"] for x in page) == list(range(491, 501))
    assert ordering.ranked(spark.createDataFrame([], "id long"), "id").count() == 0


def test_entities_in_answers(spark):
    rows = [
        (1, '{"tool_calls": [{"arguments": {"entities": {"entity": "1", "entity_type": "PERSON"}}}]}'), (2, '{"tool_calls": [{"arguments": "{\\"entities\\": [{\\"entity\\": \\"a\\"}]}"}, 7, {"arguments": {"entities": [5, {"entity": "b"}]}}]}'),
        (3, '{"tool_calls": [{"arguments": "no json"}, {"arguments": {"entities": "x"}}, {}]}'), (4, '{"tool_calls": null}'), (5, None), (6, "[1]"),
    ]
    got = graph.extracted(spark.createDataFrame(rows, "id int, payload string")).orderBy("id", "call_no").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, "1", "PERSON"), (2, 0, 0, "a", None), (2, 2, 0, "b", None)]


def test_medians_by_rank(spark):
    from tessera.plans.relational import upper_median_of

    r = random.Random(9)
    rows = [(k, None if r.random() < 0.1 else r.randrange(20) / 2) for k in "abc" for _ in range(r.randrange(1, 90))] + [("d", None), ("e", 1.0), ("e", 2.0)]
    want = {}
    for k in "abcde":
        values = sorted(v for key, v in rows if key == k and v is not None)
        want |= {k: values[len(values) // 2]} if values else {}
    got = {x.k: x.median for x in upper_median_of(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v").collect()}
    assert got == want
