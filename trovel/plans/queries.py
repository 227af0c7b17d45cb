"""Named queries over the driver's tables, and their DuckDB forms. QUERIES holds (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovel import providers
from trovel.functions import scores as S
from trovel.functions import text as T
from trovel.operators import chunks, contexts, graph, metrics, retrieval, tables
from trovel.plans.model import Model
from trovel.plans.oracle_base import BASE
from trovel.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Registers a function of a Model under its own name, with its DuckDB form."""

    def register(f: Callable[[Model], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = (BASE if base else "") + sql
        return f

    return register


def r6(c: str, name: str | None = None) -> F.Column:
    return F.round(F.col(c).cast("double"), 6).alias(name or c)


def big(c: str, name: str | None = None) -> F.Column:
    return F.col(c).cast("long").alias(name or c)


# Retrieval


@query("SELECT query_id, rank::BIGINT AS rank, doc_id, chunk_index, round(score, 6) AS score FROM rag")
def vector_topk_docs(m: Model) -> DataFrame:
    return m.rag().select("query_id", big("rank"), "doc_id", "chunk_index", r6("score"))


@query("SELECT query_id, rank::BIGINT AS rank, doc_id, round(score, 6) AS score FROM sem")
def semantic_full_rank(m: Model) -> DataFrame:
    return m.semantic().select("query_id", big("rank"), "doc_id", r6("score"))


@query("SELECT query_id, doc_id, round(score, 6) AS score FROM sem WHERE rank <= 10")
def semantic_seeds(m: Model) -> DataFrame:
    return m.semantic_top().where("rank <= 10").select("query_id", "doc_id", r6("score"))


@query("SELECT destino, freq, round(idf, 6) AS idf FROM freq")
def entity_idf(m: Model) -> DataFrame:
    return retrieval.entity_idf(m.graph()[1], m.table("documents").count()).select("destino", "freq", r6("idf"))


@query("SELECT query_id, doc_id, round(score, 6) AS score FROM expanded")
def graph_expand_scores(m: Model) -> DataFrame:
    return m.expanded().select("query_id", "doc_id", r6("score"))


@query("""SELECT query_id, doc_id, round(sum(part), 6) AS score FROM (SELECT r.query_id, t.origem, r.part, replace(t.origem, 'documento::', '')::BIGINT AS doc_id, seed FROM reached r
  JOIN (SELECT DISTINCT origem, destino FROM typed) t USING (destino)) WHERE doc_id <> seed GROUP BY ALL""")
def graph_expand_demo(m: Model) -> DataFrame:
    return m.expanded(self_contribution=False, same_relation=False).select("query_id", "doc_id", r6("score"))


@query("""SELECT query_id, rank_final::BIGINT AS rank_final, doc_id, round(score_final, 6) AS score_final, rank_semantic::BIGINT AS rank_semantic, round(score_semantic, 6) AS score_semantic,
  rank_graph::BIGINT AS rank_graph, round(score_graph, 6) AS score_graph, round(rrf_semantic, 6) AS rrf_semantic, round(rrf_graph, 6) AS rrf_graph, was_seed FROM entity""")
def entity_top10(m: Model) -> DataFrame:
    cols = [big("rank_final"), "doc_id", r6("score_final"), big("rank_semantic"), r6("score_semantic"), big("rank_graph"), r6("score_graph"), r6("rrf_semantic"), r6("rrf_graph"), "was_seed"]
    return m.entity().select("query_id", *cols)


@query("""SELECT query_id, rank_final::BIGINT AS rank_final, doc_id, rank_rag::BIGINT AS rank_rag, rank_entity::BIGINT AS rank_entity, round(rrf_rag, 6) AS rrf_rag, round(rrf_entity, 6) AS rrf_entity,
  round(score_final, 6) AS score_final, origin FROM hybrid""")
def hybrid_rrf_top10(m: Model) -> DataFrame:
    return m.hybrid().select("query_id", big("rank_final"), "doc_id", big("rank_rag"), big("rank_entity"), r6("rrf_rag"), r6("rrf_entity"), r6("score_final"), "origin")


@query("""SELECT query_id, doc_id, chunk_index, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index) AS n
  FROM scored SEMI JOIN result USING (query_id, doc_id)) WHERE n = 1""")
def best_chunk_per_doc(m: Model) -> DataFrame:
    wanted = m.rag().select("query_id", "doc_id").unionByName(m.entity().select("query_id", "doc_id"))
    return retrieval.best_chunk(wanted, retrieval.score_pairs(m.queries(), m.vectors(), wanted)).select("query_id", "doc_id", "chunk_index", r6("score"))


@query("""SELECT query_id, doc_id, n::BIGINT AS n, seed, destino, tipo, round(part, 6) AS part FROM (
  SELECT e.query_id, e.doc_id, seed, destino, tipo, part, row_number() OVER (PARTITION BY e.query_id, e.doc_id ORDER BY round(part, 9) DESC, seed, destino) AS n
  FROM entity e JOIN typed t ON t.origem = 'documento::' || e.doc_id JOIN reached USING (query_id, destino, tipo)) WHERE n <= 5""")
def evidence_top5(m: Model) -> DataFrame:
    seeds = m.semantic_top().where("rank <= 10").select("query_id", "doc_id", "score")
    found = retrieval.evidence(seeds, m.graph()[1], m.table("documents").count(), m.entity())
    rows = found.select("query_id", "doc_id", F.posexplode("evidence").alias("at", "link"))
    return rows.select("query_id", "doc_id", (F.col("at") + 1).cast("long").alias("n"), "link.seed", "link.destino", "link.tipo", r6("link.part", "part"))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS self_score FROM embeddings", base=False)
def unit_vectors(m: Model) -> DataFrame:
    v = m.table("embeddings").withColumn("u", S.unit("embedding"))
    return v.select("vec_id", F.round(F.sqrt(S.dot("embedding", "embedding")), 6).alias("norm"), F.round(S.dot("u", "u"), 6).alias("self_score"))


# Evaluation

METRIC_COLUMNS = ("p_at_10", "r_at_10", "mrr_at_10", "ndcg_at_10", "judged_at_10")
_ROUNDED = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in METRIC_COLUMNS)
_COUNTS = "n_hits::BIGINT AS n_hits, n_judged::BIGINT AS n_judged, n_relevant::BIGINT AS n_relevant, first_relevant::BIGINT AS first_relevant"


def _metrics(system: str) -> None:
    sql = f"SELECT query_id, source, {_ROUNDED}, {_COUNTS} FROM metric WHERE system = '{system}'"

    def f(m: Model) -> DataFrame:
        return m.metrics(system).select("query_id", "source", *[r6(c) for c in METRIC_COLUMNS], big("n_hits"), big("n_judged"), big("n_relevant"), big("first_relevant"))

    f.__name__ = f"metrics_per_query_{system}"
    query(sql)(f)


for _system in ("rag", "entity", "hybrid"):
    _metrics(_system)

_MEANS = ", ".join(f"round(avg({c})::DOUBLE, 6) AS {c}" for c in METRIC_COLUMNS)


@query(f"SELECT CASE WHEN grouping(source) = 1 THEN 'global' ELSE 'source' END AS scope, coalesce(source, 'all') AS grp, count(*) AS n_queries, {_MEANS} FROM metric WHERE system = 'hybrid' GROUP BY ROLLUP (source)")
def metrics_by_source_rollup(m: Model) -> DataFrame:
    return metrics.by_source(m.metrics("hybrid")).select("scope", "grp", "n_queries", *[r6(c) for c in METRIC_COLUMNS])


@query(f"""SELECT scope, grp, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT CASE WHEN grouping(source) = 1 THEN 'global' ELSE 'source' END AS scope, coalesce(source, 'all') AS grp, {_MEANS} FROM metric WHERE system = 'hybrid' GROUP BY ROLLUP (source))
  ON {", ".join(METRIC_COLUMNS)} INTO NAME metric VALUE value)""")
def summary_long_unpivot(m: Model) -> DataFrame:
    return metrics.long_form(metrics.by_source(m.metrics("hybrid"))).select("scope", "grp", "metric", r6("value"))


@query("""SELECT query_id, rank::BIGINT AS rank, doc_id, grade, grade IS NOT NULL AS judged, coalesce(grade > 0, false) AS relevant,
  CASE grade WHEN 0 THEN 'irrelevant' WHEN 1 THEN 'related' WHEN 2 THEN 'relevant' WHEN 3 THEN 'highly relevant' ELSE 'not judged' END AS label FROM rag LEFT JOIN qrel USING (query_id, doc_id)""")
def judged_results(m: Model) -> DataFrame:
    return metrics.judged(m.rag(), m.qrels()).select("query_id", big("rank"), "doc_id", "grade", "judged", "relevant", T.grade_label(F.col("grade")).alias("label"))


@query("SELECT rank::BIGINT AS rank, count(*) AS n, count(grade) AS n_judged, count(*) FILTER (grade > 0) AS n_relevant, round(avg(CASE WHEN grade > 0 THEN 1 ELSE 0 END)::DOUBLE, 6) AS share FROM rag LEFT JOIN qrel USING (query_id, doc_id) GROUP BY ALL")
def relevance_by_rank(m: Model) -> DataFrame:
    rows = metrics.judged(m.rag(), m.qrels()).groupBy("rank").agg(F.count("*").alias("n"), F.count_if("judged").alias("n_judged"), F.count_if("relevant").alias("n_relevant"), F.avg(F.col("relevant").cast("int")).alias("share"))
    return rows.select(big("rank"), "n", "n_judged", "n_relevant", r6("share"))


@query("SELECT source, count(*) AS n_queries, sum(n_judged)::BIGINT AS n_judged, round(avg(judged_at_10)::DOUBLE, 6) AS coverage, min(n_judged)::BIGINT AS least, max(n_judged)::BIGINT AS most FROM metric WHERE system = 'rag' GROUP BY ALL")
def coverage_by_source(m: Model) -> DataFrame:
    rows = m.metrics("rag").groupBy("source").agg(F.count("*").alias("n_queries"), F.sum("n_judged").alias("n_judged"), F.avg("judged_at_10").alias("coverage"), F.min("n_judged").alias("least"), F.max("n_judged").alias("most"))
    return rows.select("source", "n_queries", big("n_judged"), r6("coverage"), big("least"), big("most"))


@query("SELECT query_id, source, count(*) AS n_results, count(grade) AS n_judged, round(count(grade) / 10, 6) AS coverage FROM rag JOIN q USING (query_id) LEFT JOIN qrel USING (query_id, doc_id) GROUP BY ALL")
def coverage_per_query(m: Model) -> DataFrame:
    rows = metrics.judged(m.rag(), m.qrels()).join(m.queries().select("query_id", "source"), "query_id")
    return rows.groupBy("query_id", "source").agg(F.count("*").alias("n_results"), F.count_if("judged").alias("n_judged"), F.round(F.count_if("judged") / 10, 6).alias("coverage"))


@query("SELECT query_id, count(*) FILTER (was_seed) AS n_seeds, count(*) FILTER (NOT was_seed) AS n_new, count(grade) AS n_judged, count(*) FILTER (grade > 0) AS n_relevant FROM entity LEFT JOIN qrel USING (query_id, doc_id) GROUP BY ALL")
def seeds_and_new(m: Model) -> DataFrame:
    rows = metrics.judged(m.entity(), m.qrels())
    return rows.groupBy("query_id").agg(F.count_if("was_seed").alias("n_seeds"), F.count_if(~F.col("was_seed")).alias("n_new"), F.count_if("judged").alias("n_judged"), F.count_if("relevant").alias("n_relevant"))


@query("""SELECT v.rank::BIGINT AS rank, v.doc_id, grade, grade IS NOT NULL AS judged FROM (VALUES (1, 13), (2, 0), (3, 37), (4, 999999999)) v(rank, doc_id) LEFT JOIN (SELECT * FROM qrel WHERE query_id = 100) USING (doc_id)""")
def fixed_ranking_check(m: Model) -> DataFrame:
    """A ranking written down by hand, for one query, held against its judgements."""
    fixed = files.literal_ids(m.spark, [13, 0, 37, 999_999_999]).withColumn("query_id", F.lit(100).cast("long"))
    return metrics.judged(fixed, m.qrels()).select(big("rank"), "doc_id", "grade", "judged")


@query("""SELECT query_id, count(*) FILTER (change = 'removed') AS n_removed, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (change = 'new') AS new_ids, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (change = 'removed') AS removed_ids FROM (
  SELECT query_id, doc_id, CASE WHEN g.query_id IS NULL THEN 'removed' WHEN r.query_id IS NULL THEN 'new' ELSE 'kept' END AS change FROM rag r FULL JOIN entity g USING (query_id, doc_id)) GROUP BY ALL""")
def changed_ids(m: Model) -> DataFrame:
    rows = tables.set_changes(m.rag(), m.entity(), ["query_id", "doc_id"])
    ids = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.col("doc_id")))), lambda x: x.cast("string")), ",")
    return rows.groupBy("query_id").agg(F.count_if(F.col("change") == "removed").alias("n_removed"), F.nullif(ids("new"), F.lit("")).alias("new_ids"), F.nullif(ids("removed"), F.lit("")).alias("removed_ids"))


@query("SELECT grade, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM rag JOIN qrel USING (query_id, doc_id) GROUP BY grade")
def grade_histogram(m: Model) -> DataFrame:
    rows = metrics.judged(m.rag(), m.qrels()).where("judged")
    return tables.with_share(tables.value_counts(rows, "grade")).select("grade", "n", r6("share"))


@query("SELECT query_id, source FROM metric WHERE system = 'rag' AND r_at_10 = 0")
def zero_hit_queries(m: Model) -> DataFrame:
    return m.metrics("rag").where("r_at_10 = 0").select("query_id", "source")


@query("SELECT system, count(*) FILTER (n_hits = 0) AS n_zero FROM metric GROUP BY ALL")
def zero_hit_by_system(m: Model) -> DataFrame:
    rows = [m.metrics(s).agg(F.count_if(F.col("n_hits") == 0).alias("n_zero")).select(F.lit(s).alias("system"), "n_zero") for s in ("rag", "entity", "hybrid")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""SELECT kind, query_id, round(ndcg_at_10::DOUBLE, 6) AS ndcg_at_10 FROM ((SELECT 'best' AS kind, query_id, ndcg_at_10 FROM metric WHERE system = 'rag' ORDER BY round(ndcg_at_10::DOUBLE, 9) DESC, query_id LIMIT 5)
  UNION ALL (SELECT 'worst', query_id, ndcg_at_10 FROM metric WHERE system = 'rag' ORDER BY round(ndcg_at_10::DOUBLE, 9), query_id LIMIT 5))""")
def best_worst_queries(m: Model) -> DataFrame:
    rows, key = m.metrics("rag"), F.round("ndcg_at_10", 9)
    pick = lambda kind, order: rows.orderBy(order, "query_id").limit(5).select(F.lit(kind).alias("kind"), "query_id", r6("ndcg_at_10"))
    return pick("best", key.desc()).unionByName(pick("worst", key.asc()))


@query("""SELECT metric, source, count(value) AS n, round(avg(value)::DOUBLE, 6) AS mean, round(stddev_samp(value)::DOUBLE, 6) AS std, round(min(value)::DOUBLE, 6) AS min, round(quantile_cont(value, 0.25)::DOUBLE, 6) AS p25,
  round(quantile_cont(value, 0.5)::DOUBLE, 6) AS p50, round(quantile_cont(value, 0.75)::DOUBLE, 6) AS p75, round(max(value)::DOUBLE, 6) AS max FROM tall WHERE system = 'rag' GROUP BY ALL""")
def describe_metrics(m: Model) -> DataFrame:
    rows = tables.describe(m.metrics("rag"), list(metrics.METRICS), by=["source"])
    return rows.select("metric", "source", "n", *[r6(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


# Paired statistics


@query("SELECT comparison, metric, query_id, source, round(delta, 6) AS delta, CASE WHEN delta > 1e-12 THEN 'b' WHEN delta < -1e-12 THEN 'a' ELSE 'tie' END AS winner FROM pair")
def paired_delta(m: Model) -> DataFrame:
    return m.paired().select("comparison", "metric", "query_id", "source", r6("delta"), S.winner(F.col("delta")).alias("winner"))


_SUMMARY = """round(avg(value_a), 6) AS mean_a, round(avg(value_b), 6) AS mean_b, round(avg(delta), 6) AS delta, count(*) FILTER (delta < -1e-12) AS wins_a, count(*) FILTER (delta > 1e-12) AS wins_b,
  count(*) FILTER (abs(delta) <= 1e-12) AS ties, round(100 * avg(delta) / nullif(avg(value_a), 0), 6) AS change_pct"""


@query(f"SELECT comparison, metric, {_SUMMARY} FROM pair GROUP BY ALL")
def paired_winloss(m: Model) -> DataFrame:
    return metrics.summary(m.paired()).select("comparison", "metric", r6("mean_a"), r6("mean_b"), r6("delta"), "wins_a", "wins_b", "ties", r6("change_pct"))


@query(f"SELECT comparison, source, metric, {_SUMMARY} FROM pair GROUP BY ALL")
def paired_by_source(m: Model) -> DataFrame:
    return metrics.summary(m.paired(), ("comparison", "source", "metric")).select("comparison", "source", "metric", r6("mean_a"), r6("mean_b"), r6("delta"), "wins_a", "wins_b", "ties", r6("change_pct"))


@query("""SELECT comparison, metric, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM (SELECT d.comparison, d.metric, draw, avg(p.delta) AS m
  FROM draw d JOIN place_in_pair p ON p.comparison = d.comparison AND p.metric = d.metric AND p.i = d.h % d.n GROUP BY ALL) GROUP BY ALL""")
def bootstrap_ci_md5(m: Model) -> DataFrame:
    return metrics.bootstrap(m.paired()).select("comparison", "metric", r6("low"), r6("high"))


@query("""SELECT comparison, metric, round((count(*) FILTER (m >= seen - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM (SELECT comparison, metric, draw, abs(avg(CASE WHEN h % 2 = 0 THEN delta ELSE -delta END)) AS m FROM draw GROUP BY ALL)
  JOIN (SELECT comparison, metric, abs(avg(delta)) AS seen FROM pair GROUP BY ALL) USING (comparison, metric) GROUP BY ALL""")
def permutation_p_md5(m: Model) -> DataFrame:
    return metrics.permutation(m.paired()).select("comparison", "metric", r6("p"))


@query()
def bootstrap_permutation_exact(m: Model) -> DataFrame:
    return metrics.exact_tests(m.paired(), draws=10_000)


@query("""SELECT query_id, doc_id, CASE WHEN r.query_id IS NOT NULL AND g.query_id IS NOT NULL THEN 'kept' WHEN r.query_id IS NOT NULL THEN 'removed' ELSE 'new' END AS change FROM rag r FULL JOIN entity g USING (query_id, doc_id)""")
def rank_setdiff(m: Model) -> DataFrame:
    return tables.set_changes(m.rag(), m.entity(), ["query_id", "doc_id"])


@query("""SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS removed FROM rag ANTI JOIN entity USING (query_id, doc_id) GROUP BY ALL""")
def removed_in_order(m: Model) -> DataFrame:
    gone = m.rag().join(m.entity().select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return gone.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("removed"))


@query("""SELECT count(*) AS n_promoted, count(grade) AS n_judged, count(*) FILTER (grade > 0) AS n_relevant, round(count(*) FILTER (grade > 0) / nullif(count(grade), 0), 6) AS precision_judged FROM entity LEFT JOIN qrel USING (query_id, doc_id) WHERE NOT was_seed""")
def promoted_diag(m: Model) -> DataFrame:
    rows = metrics.judged(m.entity().where("NOT was_seed"), m.qrels()).agg(F.count("*").alias("n_promoted"), F.count_if("judged").alias("n_judged"), F.count_if("relevant").alias("n_relevant"))
    return rows.withColumn("precision_judged", F.round(S.ratio(F.col("n_relevant"), F.col("n_judged")), 6))


@query("""SELECT kind, query_id, round(delta, 6) AS delta, n_kept, n_new FROM (
  (SELECT 'gain' AS kind, query_id, delta FROM pair WHERE comparison = 'rag_vs_entity' AND metric = 'ndcg_at_10' ORDER BY round(delta, 9) DESC, query_id LIMIT 10)
  UNION ALL (SELECT 'loss', query_id, delta FROM pair WHERE comparison = 'rag_vs_entity' AND metric = 'ndcg_at_10' ORDER BY round(delta, 9), query_id LIMIT 10))
  JOIN (SELECT query_id, count(*) FILTER (r.rank IS NOT NULL) AS n_kept, count(*) FILTER (r.rank IS NULL) AS n_new FROM entity LEFT JOIN rag r USING (query_id, doc_id) GROUP BY ALL) USING (query_id)""")
def extreme_cases(m: Model) -> DataFrame:
    rows = metrics.paired({"rag": m.metrics("rag"), "entity": m.metrics("entity")}).where("metric = 'ndcg_at_10'")
    pick = lambda kind, order: rows.orderBy(order, "query_id").limit(10).select(F.lit(kind).alias("kind"), "query_id", r6("delta"))
    changes = tables.set_changes(m.rag(), m.entity(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count_if(F.col("change") == "kept").alias("n_kept"), F.count_if(F.col("change") == "new").alias("n_new"))
    key = F.round("delta", 9)
    return pick("gain", key.desc()).unionByName(pick("loss", key.asc())).join(changes, "query_id").select("kind", "query_id", "delta", "n_kept", "n_new")


# Graph


@query("SELECT node_id, tipo, nome, doc_id FROM node")
def graph_nodes(m: Model) -> DataFrame:
    return m.graph()[0].select("node_id", "tipo", "nome", "doc_id")


@query("SELECT origem, destino, tipo FROM edge")
def graph_edges(m: Model) -> DataFrame:
    return m.graph()[1].select("origem", "destino", "tipo")


@query("SELECT 'node' AS what, tipo, count(*) AS n FROM node GROUP BY ALL UNION ALL SELECT 'edge', tipo, count(*) FROM edge GROUP BY ALL")
def graph_type_counts(m: Model) -> DataFrame:
    return graph.type_counts(*m.graph())


@query("SELECT node_id, nome, coalesce(degree, 0)::BIGINT AS degree FROM node LEFT JOIN deg USING (node_id) WHERE tipo = 'conceito' ORDER BY coalesce(degree, 0) DESC, node_id LIMIT 20")
def graph_degree_top(m: Model) -> DataFrame:
    return graph.by_degree(*m.graph(), "conceito", 20)


@query("SELECT node_id, nome, coalesce(degree, 0)::BIGINT AS degree FROM node LEFT JOIN deg USING (node_id) WHERE tipo = 'conceito' ORDER BY coalesce(degree, 0), node_id LIMIT 20")
def graph_degree_bottom(m: Model) -> DataFrame:
    return graph.by_degree(*m.graph(), "conceito", 20, largest=False)


@query("SELECT node_id, nome, coalesce(degree, 0)::BIGINT AS degree FROM node LEFT JOIN deg USING (node_id) WHERE tipo = 'referencia_legal' ORDER BY coalesce(degree, 0) DESC, node_id LIMIT 30")
def graph_degree_references(m: Model) -> DataFrame:
    return graph.by_degree(*m.graph(), "referencia_legal", 30)


@query("SELECT node_id, tipo FROM node ANTI JOIN deg USING (node_id)")
def graph_isolated(m: Model) -> DataFrame:
    return graph.isolated(*m.graph()).select("node_id", "tipo")


@query("""SELECT relation, count(*) FILTER (origem IS NULL) AS n_missing FROM (SELECT node_id FROM node WHERE tipo = 'documento') CROSS JOIN (VALUES ('TEM_AREA'), ('TEM_TEMA'), ('TEM_SUBTEMA'), ('TEM_AUTOR_TESE'), ('TEM_TIPO_PROCESSO')) v(relation)
  LEFT JOIN (SELECT DISTINCT origem, tipo FROM edge) ON origem = node_id AND tipo = relation GROUP BY ALL""")
def graph_missing_relations(m: Model) -> DataFrame:
    return graph.missing_relations(*m.graph())


@query("SELECT nome AS area, count(origem) AS n_temas FROM node LEFT JOIN (SELECT origem FROM edge WHERE tipo = 'POSSUI_TEMA') ON origem = node_id WHERE node.tipo = 'area' GROUP BY ALL")
def graph_hierarchy(m: Model) -> DataFrame:
    return graph.hierarchy(*m.graph())


@query("SELECT edge.tipo, nome, destino FROM edge JOIN node ON node_id = destino WHERE origem = 'documento::7'")
def graph_ego(m: Model) -> DataFrame:
    return graph.ego(*m.graph(), 7)


@query("""SELECT origem AS node_id, destino AS neighbour, tipo, 'out' AS direction FROM edge WHERE origem IN ('documento::3', 'area::en', 'area::fr') UNION ALL SELECT destino, origem, tipo, 'in' FROM edge WHERE destino IN ('documento::3', 'area::en', 'area::fr')""")
def graph_neighbours(m: Model) -> DataFrame:
    return graph.neighbours(m.graph()[1], m.spark.createDataFrame([("documento::3",), ("area::en",), ("area::fr",)], "node_id string"))


@query("SELECT node_id, nome FROM node WHERE tipo = 'referencia_legal' AND (lower(trim(nome)) IN ('inc.', 'art.', 'par.', 'alínea', 'congresso nacional', 'tcu', 'presidente da república') OR length(trim(nome)) <= 5)")
def graph_reference_fragments(m: Model) -> DataFrame:
    return graph.fragments(m.graph()[0])


@query("SELECT DISTINCT area, tema, subtema FROM doc")
def taxonomy_distinct(m: Model) -> DataFrame:
    return m.documents().select("area", "tema", "subtema").distinct()


@query("SELECT area, tema, subtema, count(*) AS n FROM doc GROUP BY ALL")
def taxonomy_counts(m: Model) -> DataFrame:
    return m.documents().groupBy("area", "tema", "subtema").agg(F.count("*").alias("n"))


@query("""SELECT s.n_name AS a, t.n_name AS b, 'trades with' AS relation FROM (SELECT DISTINCT c_nationkey AS x, s_nationkey AS y FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)
  JOIN nation s ON s.n_nationkey = x JOIN nation t ON t.n_nationkey = y""", base=False)
def valid_relations(m: Model) -> DataFrame:
    pairs = m.table("customer").join(m.table("orders"), F.col("o_custkey") == F.col("c_custkey")).join(m.table("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(m.table("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    edges = pairs.select(F.col("c_nationkey").cast("string").alias("origem"), F.col("s_nationkey").cast("string").alias("destino"), F.lit("trades with").alias("tipo")).distinct()
    nodes = m.table("nation").select(F.col("n_nationkey").cast("string").alias("node_id"), "n_name")
    kept = graph.valid_subgraph(nodes, edges)[1]
    name = lambda c, n: nodes.select(F.col("node_id").alias(c), F.col("n_name").alias(n))
    return kept.join(F.broadcast(name("origem", "a")), "origem").join(F.broadcast(name("destino", "b")), "destino").select("a", "b", F.col("tipo").alias("relation"))


# Corpus and text


@query("""WITH w AS (SELECT len(list_filter(string_split_regex(coalesce(text, ''), '[\\s\\p{Z}]+'), lambda x: x <> '')) AS n FROM documents)
SELECT CASE WHEN n <= 250 THEN '0-250' WHEN n <= 500 THEN '251-500' WHEN n <= 1000 THEN '501-1000' WHEN n <= 2000 THEN '1001-2000' WHEN n <= 5000 THEN '2001-5000' ELSE '5001+' END AS bucket, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM w GROUP BY ALL""", base=False)
def corpus_word_buckets(m: Model) -> DataFrame:
    ranges = [("0-250", 0, 250), ("251-500", 251, 500), ("501-1000", 501, 1000), ("1001-2000", 1001, 2000), ("2001-5000", 2001, 5000), ("5001+", 5001, None)]
    rows = m.table("documents").select(tables.buckets(T.word_count(F.col("text")), ranges).alias("bucket"))
    return tables.with_share(tables.value_counts(rows, "bucket")).select("bucket", "n", F.round(100 * F.col("share"), 6).alias("percent"))


_WINDOWS = """WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\s\\p{Z}]+'), lambda x: x <> '') AS t FROM documents),
c AS (SELECT doc_id, t, unnest(range(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 480 THEN 1 ELSE ceil((len(t) - 480) / 400)::BIGINT + 1 END)) AS i FROM w)"""


@query(_WINDOWS + " SELECT doc_id, i::BIGINT AS chunk_index, doc_id || '_' || i AS chunk_id, md5('passage: ' || array_to_string(t[i * 400 + 1 : i * 400 + 480], ' ')) AS text_md5, len(t[i * 400 + 1 : i * 400 + 480])::BIGINT AS num_tokens FROM c", base=False)
def chunk_windows(m: Model) -> DataFrame:
    return chunks.windows(m.table("documents")).select("doc_id", big("chunk_index"), "chunk_id", F.md5("text").alias("text_md5"), big("num_tokens"))


@query(_WINDOWS + """, s AS (SELECT doc_id, count(*) AS n FROM c GROUP BY ALL)
SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_windows, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS most FROM s""", base=False)
def chunk_stats(m: Model) -> DataFrame:
    n = chunks.window_counts(m.table("documents")).where("n_windows > 0")
    return n.agg(F.count("*").alias("n_docs"), F.sum("n_windows").alias("n_windows"), F.round(F.avg("n_windows"), 6).alias("mean"), F.round(F.percentile("n_windows", 0.5), 6).alias("p50"), F.round(F.percentile("n_windows", 0.9), 6).alias("p90"), F.max("n_windows").alias("most"))


@query(_WINDOWS + " SELECT count(*) AS n_chunks, max(len(t[i * 400 + 1 : i * 400 + 480]) + 2)::BIGINT AS longest, count(*) FILTER (len(t[i * 400 + 1 : i * 400 + 480]) + 2 > 480) AS n_over FROM c", base=False)
def chunk_limit_audit(m: Model) -> DataFrame:
    return chunks.token_limit_audit(chunks.windows(m.table("documents")), limit=480)


@query("SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[\\s\\p{Z}]+'), lambda x: x <> ''))::BIGINT AS n_words FROM documents ORDER BY 2 DESC, 1 LIMIT 5", base=False)
def longest_documents(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", T.word_count(F.col("text")).alias("n_words")).orderBy(F.desc("n_words"), "doc_id").limit(5)


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '</?(p|br|div|tr|td|table)[^>]*>', ' ', 'gi'), '<[^>]+>', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) AS text FROM pages""", base=False)
def html_strip_pages(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))


@query()
def html_clean_pages(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", T.clean_html(F.col("html")).alias("text"))


@query()
def unicode_ids(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", T.unicode_identifier(F.col("text")).alias("id"))


@query("""SELECT 'text' AS column_name, count(*) AS n_rows, count(*) FILTER (text IS NULL) AS n_null, count(*) FILTER (trim(text) = '') AS n_blank, count(DISTINCT text) AS n_distinct FROM documents
UNION ALL SELECT 'lang', count(*), count(*) FILTER (lang IS NULL), count(*) FILTER (trim(lang) = ''), count(DISTINCT lang) FROM documents UNION ALL SELECT 'source', count(*), count(*) FILTER (source IS NULL), count(*) FILTER (trim(source) = ''), count(DISTINCT source) FROM documents""", base=False)
def column_profile(m: Model) -> DataFrame:
    return tables.column_profile(m.table("documents"), ["text", "lang", "source"])


@query("SELECT source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, source LIMIT 15", base=False)
def top_values(m: Model) -> DataFrame:
    return tables.top_values(m.table("documents"), "source")


@query("""SELECT 'lang' AS column_name, lang AS example FROM (SELECT DISTINCT lang FROM documents WHERE trim(lang) <> '' ORDER BY lang LIMIT 10)
UNION ALL SELECT 'n_chars', n FROM (SELECT DISTINCT n_chars::VARCHAR AS n FROM documents WHERE n_chars IS NOT NULL ORDER BY n LIMIT 10)
UNION ALL SELECT 'source', source FROM (SELECT DISTINCT source FROM documents WHERE trim(source) <> '' ORDER BY source LIMIT 10)""", base=False)
def column_examples(m: Model) -> DataFrame:
    return tables.examples(m.table("documents"), ["lang", "n_chars", "source"])


@query("SELECT lang, count(DISTINCT source) AS n_sources FROM documents WHERE lang IS NOT NULL GROUP BY ALL", base=False)
def distinct_per_group(m: Model) -> DataFrame:
    return m.table("documents").where("lang IS NOT NULL").groupBy("lang").agg(F.count_distinct("source").alias("n_sources"))


@query("""SELECT lang AS metric, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars)::DOUBLE AS min, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50,
  round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars)::DOUBLE AS max FROM documents GROUP BY ALL""", base=False)
def describe_by_group(m: Model) -> DataFrame:
    rows = tables.describe(m.table("documents"), ["n_chars"], (0.25, 0.5, 0.75, 0.95), by=["lang"])
    return rows.select(F.col("lang").alias("metric"), "n", *[r6(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "p95", "max")])


@query("""SELECT page_id, list_filter(list_transform(string_split(regexp_replace(list, '^\\[|\\]$', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM (SELECT page_id, '[' || replace(replace(url, '/', ', '), '?', ',,') || ']' AS list FROM pages)""", base=False)
def list_parse(m: Model) -> DataFrame:
    made = F.concat(F.lit("["), F.replace(F.replace(F.col("url"), F.lit("/"), F.lit(", ")), F.lit("?"), F.lit(",,")), F.lit("]"))
    return m.table("pages").select("page_id", T.bracket_list(made).alias("items"))


@query("SELECT page_id, coalesce(try_cast(url AS BIGINT), try_cast(list_extract(regexp_extract_all(url, '[0-9]+'), -1) AS BIGINT)) AS number FROM pages", base=False)
def number_in_text(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", T.number_in(F.col("url")).alias("number"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", base=False)
def json_props(m: Model) -> DataFrame:
    return m.table("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT p_brand AS brand, sum(l_quantity)::DOUBLE AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""", base=False)
def revenue_by_brand(m: Model) -> DataFrame:
    rows = m.table("lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount").join(m.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("brand")).agg(F.sum("l_quantity").cast("double").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# Contexts, logs and gradings

_CHUNK_TEXT = "(SELECT doc_id, coalesce(text, '') AS text, n_chars FROM documents)"


@query(f"""SELECT query_id, count(*) AS n_docs, sum(n_chars % 480)::BIGINT AS total_tokens, md5(string_agg('[DOC_' || doc_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context_md5, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids
  FROM rag JOIN {_CHUNK_TEXT} USING (doc_id) GROUP BY ALL""")
def context_assembly(m: Model) -> DataFrame:
    docs = m.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("n_chars") % 480).alias("num_tokens"))
    rows = m.rag().join(docs, "doc_id").withColumn("chunk_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    out = contexts.assemble(rows, ["query_id"])
    return out.select("query_id", "n_docs", big("total_tokens"), F.md5("context").alias("context_md5"), F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"))


@query(""", w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\s\\p{Z}]+'), lambda x: x <> '') AS t FROM documents),
n AS (SELECT doc_id, t, CASE WHEN len(t) <= 480 THEN 1 ELSE ceil((len(t) - 480) / 400)::BIGINT + 1 END AS n_windows FROM w SEMI JOIN rag USING (doc_id)),
p AS (SELECT query_id, rank, doc_id, t[(chunk_index % n_windows) * 400 + 1 : (chunk_index % n_windows) * 400 + 480] AS t FROM rag JOIN n USING (doc_id))
SELECT query_id, count(*) AS n_docs, sum(len(t))::BIGINT AS total_tokens, md5(string_agg('[DOC_' || doc_id || ']' || chr(10) || array_to_string(t, ' '), chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM p GROUP BY ALL""")
def context_best_chunks(m: Model) -> DataFrame:
    """Contexts of the best window of each document, with its own tokens: a document's vectors go round its windows in turn. A
    text without tokens is an empty block of none."""
    docs = m.table("documents").join(m.rag().select("doc_id").distinct(), "doc_id", "left_semi")
    found = chunks.windows(docs, prefix="").select("doc_id", F.col("chunk_index").alias("window"), "text", "num_tokens")
    turns = chunks.window_counts(docs).select("doc_id", F.greatest("n_windows", F.lit(1)).alias("n_windows"))
    rows = m.rag().join(turns, "doc_id").withColumn("window", (F.col("chunk_index") % F.col("n_windows")).cast("int")).join(found, ["doc_id", "window"], "left")
    rows = rows.withColumns({"text": F.coalesce("text", F.lit("")), "num_tokens": F.coalesce("num_tokens", F.lit(0)), "chunk_id": F.concat_ws("_", F.col("doc_id").cast("string"), F.col("window").cast("string"))})
    return contexts.assemble(rows, ["query_id"]).select("query_id", "n_docs", big("total_tokens"), F.md5("context").alias("context_md5"))


@query("""SELECT v.system, q.query_id, coalesce(n, 0)::BIGINT AS n_docs, coalesce(n, 0) <> 10 AS short FROM q CROSS JOIN (VALUES ('rag'), ('entity'), ('hybrid')) v(system)
  LEFT JOIN (SELECT system, query_id, count(*) AS n FROM result GROUP BY ALL) r ON r.system = v.system AND r.query_id = q.query_id""")
def context_grid(m: Model) -> DataFrame:
    """Every query under every system, those without results too."""
    found = {"rag": m.rag(), "entity": m.entity(), "hybrid": m.hybrid()}
    grid = m.queries().select("query_id", F.explode(F.array(*[F.lit(s) for s in found])).alias("system"))
    counts = [df.groupBy("query_id").agg(F.count("*").alias("n")).withColumn("system", F.lit(s)) for s, df in found.items()]
    rows = grid.join(counts[0].unionByName(counts[1]).unionByName(counts[2]), ["query_id", "system"], "left")
    return rows.select("system", "query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_docs"), (F.coalesce("n", F.lit(0)) != 10).alias("short"))


@query("SELECT system, count(DISTINCT query_id) AS n_contexts, round(avg(n), 6) AS mean_docs, min(n) AS least, max(n) AS most FROM (SELECT system, query_id, count(*) AS n FROM result GROUP BY ALL) GROUP BY ALL")
def context_by_arch_summary(m: Model) -> DataFrame:
    rows = [df.select(F.lit(s).alias("system"), "query_id") for s, df in (("rag", m.rag()), ("entity", m.entity()), ("hybrid", m.hybrid()))]
    n = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("system", "query_id").agg(F.count("*").alias("n"))
    return n.groupBy("system").agg(F.count_distinct("query_id").alias("n_contexts"), F.round(F.avg("n"), 6).alias("mean_docs"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("SELECT source, query_id FROM (SELECT source, query_id, row_number() OVER (PARTITION BY source ORDER BY query_id) AS n FROM q) WHERE n <= 2")
def pilot_topn_per_group(m: Model) -> DataFrame:
    return retrieval.ranked(m.queries(), ["query_id"], "n", ("source",), 2).select("source", "query_id")


@query("SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 1 AND length(text) % 3 = 0)", base=False)
def pending_antijoin(m: Model) -> DataFrame:
    c = m.table("conversations")
    log = c.where("turn = 1").select("conv_id", F.when(F.length("text") % 3 == 0, "ok").otherwise("erro").alias("status"))
    return tables.pending(c.where("turn % 2 = 0").select("conv_id", "turn"), log, ["conv_id"])


@query("SELECT conv_id, max(turn) AS turn, arg_max(md5(text), turn) AS text_md5 FROM conversations GROUP BY ALL", base=False)
def latest_per_key(m: Model) -> DataFrame:
    return tables.latest(m.table("conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY md5('42:' || conv_id || ':' || turn), conv_id, turn)::BIGINT AS place FROM conversations", base=False)
def seeded_shuffle(m: Model) -> DataFrame:
    return tables.seeded_places(m.table("conversations").select("conv_id", "turn"), ["conv_id", "turn"])


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY md5('42:' || conv_id || ':' || turn), conv_id, turn) AS place FROM conversations WHERE turn % 2 = 0 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 1 AND length(text) % 3 = 0)) WHERE place <= 25", base=False)
def pending_limited(m: Model) -> DataFrame:
    """The first 25 of the pending work, in seeded order: a run with a limit."""
    c = m.table("conversations")
    log = c.where("turn = 1").select("conv_id", F.when(F.length("text") % 3 == 0, "ok").otherwise("erro").alias("status"))
    return tables.next_work(c.where("turn % 2 = 0").select("conv_id", "turn"), log, ["conv_id"], order=["conv_id", "turn"], limit=25)


@query("SELECT conv_id, turn, sha256(text) AS text_sha256 FROM conversations", base=False)
def sha256_context(m: Model) -> DataFrame:
    return m.table("conversations").select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT 'only_a' AS side, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents ANTI JOIN labels USING (doc_id)) UNION ALL SELECT 'only_b', count(*) FROM (SELECT DISTINCT doc_id FROM labels ANTI JOIN documents USING (doc_id))", base=False)
def key_equality_check(m: Model) -> DataFrame:
    return tables.key_differences(m.table("documents"), m.table("labels"), ["doc_id"])


@query("SELECT text, count(*) AS n FROM (SELECT md5(text) AS text FROM documents) GROUP BY ALL HAVING count(*) > 1", base=False)
def duplicate_keys(m: Model) -> DataFrame:
    return tables.duplicate_keys(m.table("documents").select(F.md5("text").alias("text")), ["text"])


@query("""SELECT query_id, system, round(supported_claims / nullif(total_claims, 0), 6) AS faithfulness, round(unsupported_claims / nullif(total_claims, 0), 6) AS unsupported_rate, context_sufficient <> response_abstained AS appropriate_abstention FROM judge""")
def judge_derived(m: Model) -> DataFrame:
    return contexts.derived(m.judgements()).select("query_id", "system", r6("faithfulness"), r6("unsupported_rate"), "appropriate_abstention")


@query("""SELECT query_id, system FROM judge WHERE unsupported_claims > 0 OR context_sufficient = response_abstained OR relevance IS DISTINCT FROM 5 OR completeness IS DISTINCT FROM 5 OR correctness IS DISTINCT FROM 5""")
def audit_cases(m: Model) -> DataFrame:
    return contexts.audit_cases(contexts.derived(m.judgements())).select("query_id", "system")


@query("""SELECT query_id, system, '## Query ' || query_id || ' - ' || system || chr(10) || '- relevance: ' || coalesce(relevance::VARCHAR, 'null') || chr(10) || '- completeness: ' || coalesce(completeness::VARCHAR, 'null') || chr(10) || '- correctness: '
  || coalesce(correctness::VARCHAR, 'null') || chr(10) || '- total_claims: ' || total_claims || chr(10) || '- supported_claims: ' || supported_claims || chr(10) || '- unsupported_claims: ' || unsupported_claims AS markdown FROM judge""")
def audit_report(m: Model) -> DataFrame:
    return contexts.audit_report(m.judgements())


@query("""SELECT query_id, system, relevance - relevance AS same, ((5 - (n + 1) % 4 % 3) - relevance)::INT AS relevance_delta FROM judge JOIN (SELECT conv_id AS query_id, role || '_' || turn AS system, length(coalesce(text, '')) AS n FROM conversations) USING (query_id, system)""")
def grade_changes(m: Model) -> DataFrame:
    rows = contexts.grade_changes(m.judgements(), m.judgements(1), ["query_id", "system"])
    return rows.select("query_id", "system", (F.col("relevance_a") - F.col("relevance_a")).alias("same"), "relevance_delta")


@query("""SELECT query_id, system, n_broken FROM (SELECT query_id, system, CASE WHEN total_claims <> supported_claims + unsupported_claims THEN 1 ELSE 0 END::BIGINT AS n_broken FROM judge)""")
def judge_rules(m: Model) -> DataFrame:
    why = F.struct(*[F.lit("x").alias(g) for g in contexts.GRADES], F.array(F.lit("c")).alias("unsupported_claims"))
    rows = m.judgements().withColumn("justification", why)
    raw = F.to_json(F.struct(*[F.col(c) for c in contexts.JUDGE_FIELDS]), {"ignoreNullFields": "false"})
    return rows.select("query_id", "system", F.size(contexts.broken_rules(F.concat(F.lit("```json\n"), raw, F.lit("\n```")))).cast("long").alias("n_broken"))


# Event windows: beyond the reference


@query("SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", base=False)
def event_windows(m: Model) -> DataFrame:
    rows = m.table("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


# Composition, prompts and checks


@query("""SELECT doc_id, concat_ws(chr(10) || chr(10), CASE WHEN trim(lang) <> '' THEN 'Área: ' || trim(lang) END, CASE WHEN trim(source) <> '' THEN 'Tema: ' || trim(source) END, CASE WHEN n_chars > 999 THEN 'Subtema: band ' || (n_chars // 1000) END) AS text FROM documents""", base=False)
def composed_text(m: Model) -> DataFrame:
    band = F.when(F.col("n_chars") > 999, F.concat(F.lit("band "), F.expr("n_chars div 1000").cast("string")))
    return m.table("documents").select("doc_id", T.labelled_parts([("Área", F.col("lang")), ("Tema", F.col("source")), ("Subtema", band)]).alias("text"))


@query("""SELECT conv_id, turn, CASE WHEN starts_with(lower(trim(text)), 'query:') THEN trim(text) ELSE 'query: ' || trim(text) END AS query, md5(trim(text)) AS bare_md5 FROM (SELECT conv_id, turn, regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS text FROM conversations)""", base=False)
def query_prefix(m: Model) -> DataFrame:
    full = T.with_prefix(F.col("text"), "query: ")
    return m.table("conversations").select("conv_id", "turn", full.alias("query"), F.md5(T.without_prefix(F.concat(F.lit(" Passage: "), F.col("text")), "passage:")).alias("bare_md5"))


@query("""SELECT conv_id, turn, sha256('Question: ' || text || chr(10) || 'Context: ' || role) AS prompt_sha256, sha256(role) AS context_sha256 FROM conversations""", base=False)
def prompt_hashes(m: Model) -> DataFrame:
    rows = m.table("conversations").select("conv_id", "turn", F.col("text").alias("question"), F.col("role").alias("context"))
    return contexts.prompts(rows, "Question: {pergunta}\nContext: {contexto}").select("conv_id", "turn", "prompt_sha256", "context_sha256")


@query("SELECT conv_id, turn, CASE WHEN turn NOT IN (conv_id, 7) THEN turn::VARCHAR ELSE '' END AS outside FROM conversations", base=False)
def citations_outside(m: Model) -> DataFrame:
    answer = F.format_string("as [DOC_%d] and [DOC_%d] say, [DOC_7] too, [DOC_%d]", F.col("conv_id"), F.col("turn"), F.col("turn"))
    rows = m.table("conversations").select("conv_id", "turn", answer.alias("answer"), F.array(F.col("conv_id"), F.lit(7).cast("long")).alias("doc_ids"))
    return contexts.outside_citations(rows).select("conv_id", "turn", F.array_join(F.transform("outside", lambda x: x.cast("string")), ",").alias("outside"))


@query("SELECT '[' || n_name || '] --(in)--> [' || r_name || ']' AS triple FROM nation JOIN region ON r_regionkey = n_regionkey", base=False)
def triple_lines(m: Model) -> DataFrame:
    return m.table("nation").join(F.broadcast(m.table("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(T.triple_text(F.col("n_name"), F.lit("in"), F.col("r_name")).alias("triple"))


@query("SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_keys, count(*) FILTER (embedding IS NULL) AS n_null, count(DISTINCT len(embedding)) AS n_sizes FROM embeddings", base=False)
def vector_table_check(m: Model) -> DataFrame:
    return tables.check_vectors(m.table("embeddings"), "vec_id")


@query("SELECT doc_id, coalesce(nullif(lang, 'en'), source) AS label FROM documents", base=False)
def first_present_label(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", T.first_present(F.when(F.col("lang") != "en", F.col("lang")).otherwise(""), F.col("source")).alias("label"))


@query("SELECT kind, query_id, first_relevant::BIGINT AS first_relevant FROM (SELECT system AS kind, query_id, first_relevant FROM metric) WHERE first_relevant IS NOT NULL")
def first_relevant(m: Model) -> DataFrame:
    rows = [m.metrics(s).where("first_relevant IS NOT NULL").select(F.lit(s).alias("kind"), "query_id", big("first_relevant")) for s in ("rag", "entity", "hybrid")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT query_id, system FROM judge WHERE (query_id, system) NOT IN (SELECT conv_id, role || '_' || turn FROM conversations WHERE turn % 3 > 0)")
def missing_answers(m: Model) -> DataFrame:
    """Gradings whose answer is not in the log, here that of two turns in three."""
    answers = m.table("conversations").where("turn % 3 > 0").select(F.col("conv_id").alias("query_id"), F.concat_ws("_", "role", F.col("turn").cast("string")).alias("system"))
    return m.judgements().select("query_id", "system").join(answers, ["query_id", "system"], "left_anti")


@query()
def generated_answers(m: Model) -> DataFrame:
    """Answers of the stand-in generator to the contexts of the vector system."""
    docs = m.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("num_tokens"))
    rows = m.rag().join(docs, "doc_id").withColumn("chunk_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    made = contexts.prompts(contexts.assemble(rows, ["query_id"]).withColumn("question", F.lit("?")), "{contexto}\n\n{pergunta}")
    return providers.generate(made, providers.StubGenerator(), ["query_id"], wait=0.0)


@query()
def embedded_turns(m: Model) -> DataFrame:
    return providers.embed(m.table("conversations").select("conv_id", "turn", "text"), providers.HashedEmbedder()).drop("text")
