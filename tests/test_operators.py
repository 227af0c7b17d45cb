import json
import math
import random

import pytest
from pyspark.sql import functions as F

from trovel import providers
from trovel.operators import chunks, contexts, graph, metrics, retrieval, tables
from trovel.sources import files
from trovel.streaming import incremental


def test_windows(spark):
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 480, 481, 880, 881)] + [(9999, None)], "doc_id long, text string")
    counted = {r.doc_id: r.n_windows for r in chunks.window_counts(docs).collect()}
    assert counted == {0: 0, 1: 1, 480: 1, 481: 2, 880: 2, 881: 3, 9999: 0}
    made = chunks.windows(docs).where("doc_id = 881").orderBy("chunk_index").collect()
    assert [r.num_tokens for r in made] == [480, 480, 81] and made[1].text.startswith("passage: w400 ")


def test_metrics_by_hand(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "a")], "query_id long, source string")
    found = spark.createDataFrame([(1, 9, 1), (1, 5, 2), (1, 7, 3)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 5, 1), (1, 5, 1), (1, 8, 2), (1, 7, 0)], "query_id long, doc_id long, grade int")
    one, two = metrics.per_query(queries, found, qrels).orderBy("query_id").collect()
    assert (one.p_at_10, one.r_at_10, one.mrr_at_10, one.n_judged) == (0.1, 0.5, 0.5, 2)
    assert math.isclose(one.ndcg_at_10, (1 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert (two.p_at_10, two.r_at_10, two.mrr_at_10, two.ndcg_at_10, two.first_relevant) == (0, 0, 0, 0, None)


def test_expansion_by_hand(spark):
    edges = spark.createDataFrame([("documento::1", "e", "INDEXADO_POR"), ("documento::2", "e", "INDEXADO_POR"), ("area::x", "e", "POSSUI_TEMA")], "origem string, destino string, tipo string")
    seeds = spark.createDataFrame([(1, 1, 0.8)], "query_id long, doc_id long, score double")
    found = {r.doc_id: r.score for r in retrieval.expand(seeds, edges, 2).collect()}
    assert found.keys() == {1, 2} and all(math.isclose(v, 0.8 * 0.5 * math.log(1 + 2 / 3)) for v in found.values())
    assert [r.doc_id for r in retrieval.expand(seeds, edges, 2, self_contribution=False).collect()] == [2]


def test_expansion_without_own_part_keeps_small_scores(spark):
    links = [("documento::1", "e", "INDEXADO_POR"), ("documento::2", "e", "INDEXADO_POR"), ("documento::3", "e", "CITA"), ("documento::1", "lone", "CITA")]
    edges = spark.createDataFrame(links, "origem string, destino string, tipo string")
    seeds = spark.createDataFrame([(1, 1, 0.8), (1, 2, 1e-15), (2, 1, -0.5)], "query_id long, doc_id long, score double")
    idf = math.log(1 + 3 / 4)
    same = {(r.query_id, r.doc_id): r.score for r in retrieval.expand(seeds, edges, 3, self_contribution=False).collect()}
    assert same == {(1, 1): pytest.approx(1e-15 * 0.5 * idf, abs=0), (1, 2): pytest.approx(0.8 * 0.5 * idf), (2, 2): pytest.approx(-0.5 * 0.5 * idf)}
    free = {(r.query_id, r.doc_id): r.score for r in retrieval.expand(seeds, edges, 3, self_contribution=False, same_relation=False).collect()}
    assert free == {**same, (1, 3): pytest.approx((0.8 + 1e-15) * 0.5 * idf), (2, 3): pytest.approx(-0.5 * 0.5 * idf)}


def test_scores_in_blocks(spark, monkeypatch):
    random.seed(3)
    vec = lambda: [random.random() for _ in range(4)]
    vectors = spark.createDataFrame([(i, 0, vec()) for i in range(30)] + [(99, 0, None), (98, 0, [1.0])], "doc_id long, chunk_index long, embedding array<float>")
    queries = spark.createDataFrame([(i, vec()) for i in range(7)], "query_id long, q array<float>")
    rows = sorted(map(tuple, retrieval.score_chunks(queries, vectors).collect()))
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 3)
    assert len(rows) == 210 and sorted(map(tuple, retrieval.score_chunks(queries, vectors).collect())) == rows
    top = {(r.query_id, r.doc_id) for r in retrieval.vector_topk(retrieval.score_chunks(queries, vectors, 5), chunks=5, docs=3).collect()}
    want = {(q, d) for q in range(7) for _, d in sorted((-s, d) for qq, d, _, s in rows if qq == q)[:3]}
    assert top == want
    assert retrieval.score_chunks(queries.limit(0), vectors).count() == 0


def test_fusion_ties(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 7, 1), (1, 6, 2)], "query_id long, doc_id long, rank int")
    found = retrieval.hybrid(a, b).orderBy("rank_final").collect()
    assert [(r.doc_id, r.origin) for r in found] == [(6, "ambos"), (5, "rag"), (7, "entity")]


def test_graph_nulls_and_empty(spark):
    schema = "doc_id long, area string, tema string, subtema string, autor string, tipo_processo string, conceitos array<string>, referencias array<string>"
    docs = spark.createDataFrame([(1, "A b", None, "s", None, " ", ["C", "c", " "], None), (2, None, "t", None, "x", None, [], ["L"]), (None, "q", None, None, None, None, None, None)], schema)
    nodes, edges = graph.build(docs)
    assert {(r.origem, r.destino) for r in edges.collect()} == {("documento::1", "area::a_b"), ("documento::1", "conceito::c"), ("documento::2", "autor::x"), ("documento::2", "referencia_legal::l")}
    assert nodes.where("node_id = 'conceito::c'").first().nome == "C" and nodes.count() == 6
    assert graph.degree(nodes, edges).where("node_id = 'documento::1'").first().degree == 2
    nodes, edges = graph.build(docs.limit(0))
    assert nodes.count() == 0 and edges.count() == 0 and graph.missing_relations(nodes, edges).count() == 5
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    kept = graph.valid_subgraph(nodes, spark.createDataFrame([("a", "b", "r"), ("a", "z", "r")], "origem string, destino string, tipo string"))
    assert kept[1].count() == 1 and {r.node_id for r in kept[0].collect()} == {"a", "b"}


GOOD = {"total_claims": 4, "supported_claims": 3, "unsupported_claims": 1, "relevance": 5, "completeness": 4, "correctness": 5, "context_sufficient": True, "response_abstained": False, "justification": {"relevance": "a", "completeness": "b", "correctness": "c", "unsupported_claims": ["x"]}}


@pytest.mark.parametrize(
    "change, broken",
    [
        ({}, []), ({"total_claims": 5}, ["sum of claims"]), ({"relevance": 6}, ["grade relevance"]), ({"relevance": None}, ["grade relevance"]), ({"relevance": "5"}, ["type relevance", "grade relevance"]), ({"context_sufficient": 1}, ["type context_sufficient"]),
        ({"response_abstained": True}, ["abstention with claims", "abstention with relevance", "abstention with completeness", "abstention with correctness"]),
        ({"response_abstained": True, "total_claims": 0, "supported_claims": 0, "unsupported_claims": 0, "relevance": None, "completeness": None, "correctness": None}, []), ({"justification": {"relevance": "a", "completeness": "b", "correctness": "c", "unsupported_claims": []}}, []),
    ],
)
def test_broken_rules(spark, change, broken):
    df = spark.createDataFrame([(json.dumps(GOOD | change),)], "raw string")
    assert df.select(contexts.broken_rules(F.col("raw")).alias("b")).first().b == broken


def test_broken_rules_of_junk(spark):
    rows = [r.b for r in spark.createDataFrame([("no json",), (None,), ("[]",)], "raw string").select(contexts.broken_rules(F.col("raw")).alias("b")).collect()]
    assert all("json" in b and "missing relevance" in b for b in rows)


def test_derived_and_audit(spark):
    rows = spark.createDataFrame([(k, "s", 0, 0, 0, 5, 5, 5, s, a) for k, (s, a) in enumerate([(True, False), (False, True)])], "query_id long, system string, total_claims long, supported_claims long, unsupported_claims long, relevance int, completeness int, correctness int, context_sufficient boolean, response_abstained boolean")
    out = contexts.derived(rows)
    assert [(r.faithfulness, r.appropriate_abstention) for r in out.orderBy("query_id").collect()] == [(None, True), (None, True)]
    assert [r.query_id for r in contexts.audit_cases(out).collect()] == [0]
    assert [r.query_id for r in contexts.audit_cases(out.withColumn("relevance", F.when(F.col("query_id") == 1, 3).otherwise(5))).collect()] == [1]


def test_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, " ")], "k long, v string")
    assert [tuple(r) for r in tables.column_profile(df, ["v"]).collect()] == [("v", 3, 1, 1, 2)]
    assert tables.first_existing(df, ["x", "v"]) == "v" and tables.existing(df, ["z", "v"]).columns == ["v"]
    with pytest.raises(ValueError):
        tables.expect_unique(df, ["k"])
    with pytest.raises(ValueError):
        tables.normalize_columns(df, {"v": "k"})
    log = spark.createDataFrame([(1, "ok"), (2, "erro")], "k long, status string")
    assert {r.k for r in tables.pending(df, log, ["k"]).collect()} == {2}


def test_providers_and_files(spark, tmp_path):
    prompt = spark.createDataFrame([(1, "[DOC_4]\nRed cats sleep. More"), (2, "none")], "query_id long, prompt string")
    out = {r.query_id: r for r in providers.generate(prompt, providers.StubGenerator(), ["query_id"], wait=0).collect()}
    assert out[1].answer == "Red cats sleep [DOC_4]" and out[2].status == "ok"
    assert providers.with_retries(lambda: "", 3, 0, lambda s: None)[1:] == (3, "blank response")
    graded = spark.createDataFrame([(providers.StubJudge().grade("q", "red cats", "red cats"),)], "raw string").select(contexts.broken_rules(F.col("raw")).alias("b")).first().b
    assert graded == []
    vectors = providers.embed(spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string"), providers.HashedEmbedder(8)).collect()
    assert math.isclose(sum(x * x for x in vectors[0].embedding), 1, rel_tol=1e-6) and vectors[1].embedding is None
    rows = spark.createDataFrame([(1, 'a "q"\nb', [1, 2])], "id long, text string, l array<int>")
    files.write_csv(rows, f"{tmp_path}/csv", one_file=True)
    assert tuple(files.read_csv(spark, f"{tmp_path}/csv", "id long, text string, l string").first()) == (1, 'a "q"\nb', "[1,2]")
    files.write_jsonl(rows, f"{tmp_path}/j"), files.append_jsonl(rows, f"{tmp_path}/j")
    assert files.read_jsonl(spark, f"{tmp_path}/j", "id long, text string, l array<int>").count() == 2
    with pytest.raises(ValueError):
        files.read_rows_of(rows, spark.createDataFrame([(7,)], "id long"), ["id"])


def test_stream_replay(spark, tmp_path):
    """Stopped and begun again, with a key that comes twice: nothing is missing or twice."""
    put = lambda name, ids: spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go(**how):
        incremental.resumable(spark, f"{tmp_path}/in", "id long", lambda b: b.withColumn("x", F.col("id") * 2), f"{tmp_path}/out", f"{tmp_path}/check", ["id"], **how).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put("a", [1, 2])
    assert go() == [1, 2]
    put("b", [2, 3])
    assert go() == [1, 2, 3] and go() == [1, 2, 3]
    with pytest.raises(ValueError):
        go(settings="other model")


def test_exact_statistics(spark):
    pairs = spark.createDataFrame([("c", "m", i, d) for i, d in enumerate([0.1, 0.2, 0.0, 0.3])], "comparison string, metric string, query_id long, delta double")
    row = metrics.exact_tests(pairs, draws=500).first()
    assert 0 <= row.low <= 0.15 <= row.high <= 0.3 and 0 < row.p <= 1


def test_unicode_ids_tell_long_texts_apart(spark):
    from trovel.plans import queries

    class Tables:
        def table(self, name):
            return spark.createDataFrame([(1, "é" * 80 + " one"), (2, "é" * 80 + " two"), (3, "Ação")], "doc_id long, text string")

    found = {r.doc_id: r.id for r in queries.unicode_ids(Tables()).collect()}
    assert found[1] != found[2] and found[1].endswith("one") and found[2].endswith("two")


def test_exact_bootstrap_draws_ten_thousand(spark):
    from trovel.plans import queries

    class Pairs:
        def paired(self):
            return spark.createDataFrame([("a_vs_b", "m", i, (i * 7 % 11) / 10 - 0.3) for i in range(30)], "comparison string, metric string, query_id long, delta double")

    row = queries.bootstrap_permutation_exact(Pairs()).first()
    assert round(row.p * 10_001, 6) == round(row.p * 10_001) and row.p > 0
    assert tuple(row) == tuple(metrics.exact_tests(Pairs().paired(), draws=10_000).first())


def test_generated_answers_see_all_ten_ranks(spark, monkeypatch):
    from trovel.plans import queries

    class Ranked:
        def table(self, name):
            return spark.createDataFrame([(i, f"text {i}") for i in range(12)], "doc_id long, text string")

        def rag(self):
            return spark.createDataFrame([(1, i + 1, i, 0, 1.0) for i in range(10)], "query_id long, rank int, doc_id long, chunk_index long, score double")

    class CountsBlocks:
        name = "counts"

        def generate(self, prompt):
            return str(prompt.count("[DOC_"))

    monkeypatch.setattr(providers, "StubGenerator", CountsBlocks)
    assert [r.answer for r in queries.generated_answers(Ranked()).collect()] == ["10"]
