"""Rankings streamed in bounded memory, held against whole ones."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovel.operators import retrieval, streams


def brute(rows, most=None):
    """The order of (key, id) rows: falling key, NaN first, then id."""
    by = sorted(range(len(rows)), key=lambda k: (0 if np.isnan(rows[k][0]) else 1, 0 if np.isnan(rows[k][0]) else -rows[k][0], rows[k][1]))
    return [rows[k] for k in by[:most]]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(streams, "GROUP", 16)
    monkeypatch.setattr(streams, "TILE", 2)


def vector_case(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(-2, 3, (12, 3)).astype(np.float32)  # few values: many ties
    pool[0, 0] = np.nan if seed % 2 else pool[0, 0]
    vectors = [[pool[k] for k in rng.integers(0, 12, rng.integers(0, 4))] for _ in range(100)]
    ids, q = rng.permutation(100), rng.normal(size=(5, 3)).round(1)

    def score(i, own):
        found = np.array([0.0 + float(q[i, 0]) * float(v[0]) + float(q[i, 1]) * float(v[1]) + float(q[i, 2]) * float(v[2]) for v in own])
        return found.max()  # NaN stays

    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 9]), pa.array([[v.tolist() for v in x] for x in vectors[a : a + 9]], pa.list_(pa.list_(pa.float32())))], names=["doc_id", "embeddings"]) for a in range(0, 100, 9)]
    return q, batches, [[(score(i, x), int(d)) for d, x in zip(ids, vectors, strict=True) if len(x)] for i in range(5)]


def same(a, b):
    return len(a) == len(b) and all(x[1] == y[1] and (x[0] == y[0] or np.isnan(x[0]) and np.isnan(y[0])) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_best_vectors_and_places(small, seed):
    q, batches, whole = vector_case(seed)
    ids = pa.array(range(5))
    found = pa.Table.from_batches(list(streams.best(iter(batches), streams.Vectors(q), ids, ["doc_id"], 7))).to_pylist()
    for i in range(5):
        assert same(brute([(r["v0"], r["doc_id"]) for r in found if r["query_id"] == i]), brute(whole[i], 7))
    wanted = [(i, k) for i in range(5) for k in random.Random(seed).sample(range(len(whole[i])), 9)]
    at, docs = np.array([i for i, _ in wanted]), pa.array([whole[i][k][1] for i, k in wanted])
    scores = {(r["query_id"], r["doc_id"]): r["v1"] for b in streams.given(iter(batches), streams.Vectors(q), ids, ["doc_id"], at, docs) for r in b.to_pylist()}
    keys = np.array([whole[i][k][0] for i, k in wanted])
    assert all(np.array_equal(scores[i, d], k, equal_nan=True) for i, d, k in zip(at.tolist(), docs.to_pylist(), keys, strict=True)) and len(scores) == len(wanted)
    counts = {(r["query_id"], r["doc_id"]): r["v0"] for b in streams.before(iter(batches), streams.Vectors(q), ids, ["doc_id"], at, docs, keys) for r in b.to_pylist()}
    order = [[d for _, d in brute(rows)] for rows in whole]
    assert counts == {(i, d): order[i].index(d) for i, d in zip(at.tolist(), docs.to_pylist(), strict=True)}


@pytest.mark.parametrize("huge", [False, True])
def test_best_links_and_places(small, huge):
    rng = np.random.default_rng(1)
    carried = sorted({(int(i), int(k)) for i, k in zip(rng.integers(0, 30, 200), rng.integers(0, 20, 200), strict=True)} | {(i, 99) for i in range(1, 30)})
    part = {x: float(rng.integers(-1, 3)) * (1e12 if huge else 0.1) for x in carried}
    lists = [sorted(set(rng.integers(0, 25, 4).tolist()) | ({99} if d % 3 else set())) for d in range(80)]
    links = lambda: streams.Links(np.array([i for i, _ in carried]), np.array([k for _, k in carried]), np.array([part[x] for x in carried]), 30)
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(range(a, min(80, a + 7))), pa.array(lists[a : a + 7])], names=["doc_id", "numbers"]) for a in range(0, 80, 7)])
    whole = [[(sum(part[i, k] for k in own if (i, k) in part), d) for d, own in enumerate(lists) if any((i, k) in part for k in own)] for i in range(30)]
    ids = pa.array(range(30))
    order = [sorted(rows, key=lambda r: (-np.rint(r[0] * 1e9), r[1])) for rows in whole]
    every = {(r["query_id"], r["doc_id"]): r["v0"] for b in streams.every(batches(), links(), ids, ["doc_id"], np.array([3]), pa.array([whole[3][0][1]])) for r in b.to_pylist()}
    want = {(i, d): s for i, rows in enumerate(whole) for s, d in rows if (i, d) != (3, whole[3][0][1])}
    assert every.keys() == want.keys() and all(every[x] == pytest.approx(want[x]) for x in want)
    found = pa.Table.from_batches(list(streams.best(batches(), links(), ids, ["doc_id"], 6))).to_pylist()
    for i in range(30):
        assert [d for _, d in brute([(r["v0"], r["doc_id"]) for r in found if r["query_id"] == i])] == [d for _, d in order[i][:6]]
    wanted = [(i, d) for i in range(30) for _, d in order[i][::5]] + [(29, 500)]
    at, docs = np.array([i for i, _ in wanted]), pa.array([d for _, d in wanted])
    rows = [r for b in streams.given(batches(), links(), ids, ["doc_id"], at, docs) for r in b.to_pylist()]
    rows.sort(key=lambda r: r["query_id"])
    assert {(r["query_id"], r["doc_id"]) for r in rows} == set(wanted[:-1])
    at, docs, keys = np.array([r["query_id"] for r in rows]), pa.array([r["doc_id"] for r in rows]), np.array([r["v0"] for r in rows])
    counts = {(r["query_id"], r["doc_id"]): r["v0"] for b in streams.before(batches(), links(), ids, ["doc_id"], at, docs, keys) for r in b.to_pylist()}
    assert counts == {(i, d): [x for _, x in order[i]].index(d) for i, d in wanted[:-1]}


def test_a_task_yields_no_more_than_a_top_k_needs(spark):
    vectors = spark.range(6_000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("chunk_index"), F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).cast("array<float>").alias("embedding")).repartition(1)
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "query_id long, q array<float>")
    found = retrieval.score_chunks(queries, vectors, 5)
    assert found.count() == 15  # of six batches of 1,000 vectors, a third of which tie
    assert sorted(r.doc_id for r in found.where("query_id = 1").collect()) == [2, 5, 8, 11, 14]


def test_fusion_of_first_places_equals_that_of_whole_rankings(spark):
    random.seed(5)
    vec = lambda: [random.gauss(0, 1) for _ in range(4)]
    pool = [vec() for _ in range(150)]
    vectors = spark.createDataFrame([(d, c, random.choice(pool)) for d in range(400) for c in range(2)], "doc_id long, chunk_index long, embedding array<float>")
    queries = spark.createDataFrame([(i, vec()) for i in range(4)], "query_id long, q array<float>")
    kinds = list(retrieval.RELATION_WEIGHTS)
    links = sorted({(f"documento::{d}", f"e{random.choice([k % 4, k])}", kinds[k % len(kinds)]) for d in range(400) for k in random.sample(range(60), 3)})
    edges = spark.createDataFrame(links, "origem string, destino string, tipo string")
    whole = retrieval.semantic_ranking(retrieval.score_chunks(queries, vectors)).cache()
    docs = retrieval.document_vectors(vectors)
    top = retrieval.semantic_top(queries, docs, retrieval.depth())
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(top) == rows(whole.where("rank <= 80"))
    seeds = top.where("rank <= 10")
    expanded = retrieval.expand(seeds, edges, 400)
    graph = retrieval.ranked(expanded.withColumn("key", F.round("score", 9)), [F.desc("key"), "doc_id"])
    carried = retrieval.carried(seeds, edges, 400)
    some = retrieval.candidates(queries, docs, carried, retrieval.entity_lists(edges, carried), top)
    assert 0 < some[0].count() < whole.count() and 0 < some[1].count() < graph.count()
    final = lambda a, b: sorted((r.query_id, r.rank_final, r.doc_id, r.rank_semantic, r.rank_graph, r.was_seed, r.score_semantic) for r in retrieval.entity(a, b).collect())
    assert final(*some) == final(whole, graph) and len(final(*some)) == 40
    whole.unpersist()
