import json

import pytest
from pyspark.sql import functions as F

from trovel import providers
from trovel.operators import answering, chunks, contexts, metrics, tables
from trovel.sources import files


class Fails(providers.StubGenerator):
    """Answers nothing that holds one of the marks."""

    def __init__(self, marks):
        self.marks = marks

    def generate(self, prompt):
        if any(m in prompt for m in self.marks):
            raise RuntimeError("busy")
        return f"said {prompt}"


def test_loop_resumes_and_asks_failures_again(spark, tmp_path):
    work = spark.createDataFrame([(i, f"p{i}.") for i in range(6)], "query_id long, prompt string")
    path, schema = f"{tmp_path}/log", "query_id long, status string, answer string, tries int"
    go = lambda model, **how: answering.answer_pending(work, path, model, ["query_id"], tries=2, wait=0, **how)
    assert go(Fails(["p3."]), limit=4) == 4
    first = [r.query_id for r in tables.seeded_order(work, ["query_id"]).limit(4).collect()]
    assert sorted(r.query_id for r in files.read_jsonl(spark, path, schema).collect()) == sorted(first)
    left = go(Fails(["p3."]))
    assert left == 6 - 4 + (1 if 3 in first else 0)
    assert go(Fails([])) == 1 and go(Fails([])) == 0
    log = files.read_jsonl(spark, path, schema)
    assert {r.query_id for r in log.where("status = 'ok'").collect()} == set(range(6)) and log.where("status = 'ok'").count() == 6
    assert files.rebuild_csv(spark, path, schema, f"{tmp_path}/csv") == log.count()
    with pytest.raises(ValueError):
        go(Fails([]), limit=0)


def test_fixed_wait():
    waits, calls = [], iter([RuntimeError, RuntimeError, None])

    def call():
        if (e := next(calls)) is not None:
            raise e("limit")
        return "ok"

    assert providers.with_retries(call, 3, 65.0, waits.append, growth=1.0) == ("ok", 3, None) and waits == [65.0, 65.0]
    with pytest.raises(KeyError):
        providers.with_retries(lambda: {}["x"], 3, 1.0, waits.append, again=RuntimeError)


def test_judge_and_regression(spark):
    class Broken(providers.StubJudge):
        def grade(self, question, context, answer):
            return "no json" if "odd" in answer else super().grade(question, context, answer)

    rows = spark.createDataFrame([(1, "q", "red cats", "red cats"), (2, "q", "red cats", "blue dogs"), (3, "q", "x", "odd"), (4, None, None, None)], "query_id long, question string, context string, answer string")
    found = {r.query_id: r for r in answering.judge(rows, Broken(), ["query_id"], wait=0).collect()}
    assert [found[k].status for k in (1, 2, 3, 4)] == ["ok", "ok", "erro", "ok"] and "json" in found[3].broken
    expected = spark.createDataFrame([(1, "relevance", 5, 5), (2, "completeness", 4, 5), (3, "relevance", 1, 5), (9, "relevance", 1, 5)], "query_id long, grade string, least int, most int")
    checked = {r.query_id: r.passed for r in answering.rubric_regression(answering.judge(rows, Broken(), ["query_id"], wait=0), expected, ["query_id"]).collect()}
    assert checked == {1: True, 2: False, 3: False, 9: False}
    text = rows.where("query_id = 4").select(answering.judge_prompt("Grade.", F.col("question"), F.col("context"), F.col("answer")).alias("p")).first().p
    assert text == "Grade.\n\nQUESTION:\n\n\nCONTEXT:\n\n\nANSWER:\n"
    assert contexts.GRADES == ("relevance", "completeness", "correctness")


def test_triples_and_chat(spark):
    docs = spark.createDataFrame([(1, "Cats chase mice. Dogs like bones."), (2, None)], "doc_id long, text string")
    found = answering.extract_triples(docs, providers.PatternTriples({"chase", "like"}), types={"Cats": "animal", "mice": "animal"}).collect()
    assert [tuple(r) for r in found] == [(1, "Cats", "mice", "chase", "animal", "animal")]
    assert answering.extract_triples(docs, providers.PatternTriples()).count() == 2
    lines = spark.createDataFrame([("[a] --(r)--> [b]",)], "triple string")
    assert answering.chat_prompt(lines, [("user", "hi"), ("assistant", "yes")], "why?") == "GRAPH:\n[a] --(r)--> [b]\n\nuser: hi\nassistant: yes\nuser: why?\nassistant:"
    with pytest.raises(ValueError):
        answering.chat_prompt(lines, [], "q", most=0)
    assert answering.embedding_limits(providers.HashedEmbedder(8), providers.WhitespaceTokenizer(), ["a b", "c"]) == {"dimensions": 8, "longest": 2}


def test_model_windows_equal_plain_ones(spark):
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 480, 481, 881)] + [(9, None)], "doc_id long, text string")
    key = lambda df: sorted(map(tuple, df.select("doc_id", "chunk_index", "chunk_id", "text", "num_tokens").collect()))
    assert key(chunks.token_windows(docs, providers.WhitespaceTokenizer())) == key(chunks.windows(docs))


def test_sinks_read_back(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>").repartition(2)
    assert files.write_vectors(vectors, f"{tmp_path}/v") == 5 and files.read_vectors(spark, f"{tmp_path}/v", 5).count() == 5
    with pytest.raises(ValueError):
        files.read_vectors(spark, f"{tmp_path}/v", 6)
    nodes, edges = spark.createDataFrame([("a", "x")], "node_id string, tipo string"), spark.createDataFrame([("a", "b", "r"), ("a", "c", "s")], "origem string, destino string, tipo string")
    files.write_graph(nodes, edges, f"{tmp_path}/g")
    back = files.read_graph(spark, f"{tmp_path}/g")
    assert back[0].collect() == nodes.collect() and sorted(map(tuple, back[1].collect())) == [("a", "b", "r"), ("a", "c", "s")]
    files.write_two_row_header(spark.createDataFrame([("u", 1.5, 2.0), ("v", 2.5, 3.0)], "k string, m__mean double, m__std double"), f"{tmp_path}/t")
    part = next((tmp_path / "t").glob("part-*"))
    assert part.read_text().splitlines() == ['k,m,m', '"",mean,std', "u,1.5,2.0", "v,2.5,3.0"]
    assert "1.5" in files.table_text(spark.createDataFrame([(1.5,)], "x double"))


def test_benchmark_files(spark, tmp_path):
    head = [c.split()[0] for c in files.DOC_SCHEMA.split(", ")]
    (tmp_path / "d.csv").write_text(",".join(head) + "\n1," + ",".join('"a ""b""\nc"' for _ in head[1:]) + "\n")
    (tmp_path / "q.csv").write_text("ID,TEXT,SOURCE\n7,what,s\n")
    (tmp_path / "r.csv").write_text("QUERY_ID,DOC_ID,SCORE,ENGINE,RANK\n7,1,3,e,1\n")
    d, q, r = files.read_benchmark(spark, f"{tmp_path}/d.csv", f"{tmp_path}/q.csv", f"{tmp_path}/r.csv")
    assert d.first().AREA == 'a "b"\nc' and tuple(q.first()) == (7, "what", "s") and tuple(r.first()) == (7, 1, 3)
    (tmp_path / "r.csv").write_text("QUERY_ID,DOC_ID,SCORE,ENGINE,RANK\n8,1,3,e,1\n")
    with pytest.raises(ValueError):
        files.read_benchmark(spark, f"{tmp_path}/d.csv", f"{tmp_path}/q.csv", f"{tmp_path}/r.csv")


def test_places_and_checks(spark):
    df = spark.createDataFrame([(i % 50, i) for i in range(3000)], "a long, b long").repartition(3)
    order = [(r.a, r.b) for r in tables.seeded_order(df, ["a", "b"]).collect()]
    assert [(r.a, r.b) for r in tables.seeded_places(df, ["a", "b"]).orderBy("place").collect()] == order
    assert tables.seeded_places(df.limit(0), ["a", "b"]).count() == 0
    names = spark.createDataFrame([(" Área ",), ("x",)], "n string")
    assert tables.require_equal(names, "n", "ÁREA").count() == 1
    with pytest.raises(ValueError):
        tables.require_equal(names, "n", "y")
    assert tables.require_rows(df, ["a"], at_least=60) is df and tables.require_rows(df, ["a"], exactly=60) is df
    with pytest.raises(ValueError):
        tables.require_rows(df, ["a"], at_least=61)
    assert metrics.timed(df, 10)["seconds_a_query"] > 0
