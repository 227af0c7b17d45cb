"""The engine's tables on the driver's: vectors, queries, judgements, documents with their taxonomy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovel.operators import graph, metrics, retrieval
from trovel.sources.files import settled


class Model:
    """Lazy tables over one folder. Every document has two chunks, each with one of the vectors, so several documents share a
    vector; vectors whose id is divisible by 100 are also the queries, searched for among all. A query's judgements are a pool of
    at most 200 documents drawn by its id and, for most queries, the documents of its own vector; the grade counts a document's
    chunks of the query's label. One document in 97 has no attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame], small: bool = True) -> DataFrame:
        """A result that several others read, worked out once: of a few rows a query, settled without its plan, since plans over
        plans would fill the driver; else persisted where memory allows and else on disk."""
        if name not in self.made:
            self.made[name] = settled(make()) if small else make().persist(StorageLevel.MEMORY_AND_DISK)
        return self.made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _chunks(self) -> DataFrame:
        n = self.table("embeddings").count()
        place = F.pmod(F.col("doc_id") * 3 + F.col("chunk_index") * 7, F.lit(n))
        return self.table("documents").select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("chunk_index")).withColumn("vec_id", place)

    def vectors(self) -> DataFrame:
        return self._chunks().join(self.table("embeddings"), "vec_id").select("doc_id", "chunk_index", "label", "embedding")

    def queries(self) -> DataFrame:
        return self.table("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("source"), F.col("label").alias("q_label"), F.col("embedding").alias("q"))

    def qrels(self) -> DataFrame:
        """No pair of a query and a document is made but those of the pools."""
        return self.once("qrels", self._qrels)

    def _qrels(self) -> DataFrame:
        docs, queries = self.table("documents").count(), self.queries().select("query_id", "q_label")
        drawn = queries.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(199)))).select("query_id", "q_label", F.pmod(F.col("query_id") * 13 + F.col("k") * 37, F.lit(docs)).alias("doc_id"))
        own = queries.where("query_id % 200 <> 0").join(self._chunks().select(F.col("vec_id").alias("query_id"), "doc_id"), "query_id").select("query_id", "q_label", "doc_id")
        chunks = self._chunks().join(self.table("embeddings").select("vec_id", "label"), "vec_id").select("doc_id", "label")
        graded = drawn.unionByName(own).distinct().join(chunks, "doc_id")
        return graded.groupBy("query_id", "doc_id").agg(F.count_if(F.col("label") == F.col("q_label")).cast("int").alias("grade"))

    def scored(self, best: int | None = None) -> DataFrame:
        return retrieval.score_chunks(self.queries().select("query_id", "q"), self.vectors(), best)

    def documents(self) -> DataFrame:
        """doc_id with area, tema, subtema, autor, tipo_processo, conceitos, referencias."""
        labels = self.table("labels").select("doc_id", F.concat(F.lit("autor "), F.col("quality").cast("string")).alias("autor"), F.concat(F.lit("tipo "), F.col("toxic").cast("string")).alias("tipo_processo"))
        low = F.lower(F.coalesce(F.col("text"), F.lit("")))
        found = (
            self.table("documents")
            .select(
                "doc_id", F.col("lang").alias("area"), F.col("source").alias("tema"), F.concat(F.lit("band "), F.expr("n_chars div 1000").cast("string")).alias("subtema"),
                F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z]{14,}"), F.lit(0))).alias("conceitos"), F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z]{12,13}|[0-9]{3}"), F.lit(0))).alias("referencias"),
            )
            .join(labels, "doc_id", "left")
        )
        return found.select("doc_id", *[F.when(F.col("doc_id") % 97 != 5, F.col(c)).alias(c) for c in found.columns if c != "doc_id"])

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes, and edges kept on disk. Both come from one reading of the texts, whose words alone are kept."""
        nodes, edges = graph.build(self.once("documents", self.documents, small=False))
        return nodes, self.once("edges", lambda: edges, small=False)

    def semantic(self) -> DataFrame:
        """Every document's place for every query: as many rows as queries times documents, so only semantic_full_rank asks for it."""
        return retrieval.semantic_ranking(self.scored())

    def document_vectors(self) -> DataFrame:
        return self.once("document vectors", lambda: retrieval.document_vectors(self.vectors()), small=False)

    def semantic_top(self) -> DataFrame:
        """The first places alone, as deep as a fusion needs."""
        return self.once("semantic", lambda: retrieval.semantic_top(self.queries().select("query_id", "q"), self.document_vectors(), retrieval.depth()))

    def rag(self) -> DataFrame:
        return self.once("rag", lambda: retrieval.vector_topk(self.scored(best=200)))

    def expanded(self, **how) -> DataFrame:
        return retrieval.expand(self.semantic_top().where("rank <= 10"), self.graph()[1], self.table("documents").count(), **how)

    def _entity(self) -> DataFrame:
        carried = self.once("carried", lambda: retrieval.carried(self.semantic_top().where("rank <= 10"), self.graph()[1], self.table("documents").count()))
        lists = self.once("entity lists", lambda: retrieval.entity_lists(self.graph()[1], carried), small=False)
        return retrieval.entity(*retrieval.candidates(self.queries().select("query_id", "q"), self.document_vectors(), carried, lists, self.semantic_top()))

    def entity(self) -> DataFrame:
        return self.once("entity", self._entity)

    def hybrid(self) -> DataFrame:
        return self.once("hybrid", lambda: retrieval.hybrid(self.rag(), self.entity().select("query_id", "doc_id", F.col("rank_final").alias("rank"))))

    def metrics(self, system: str) -> DataFrame:
        found = {"rag": self.rag, "entity": lambda: self.entity().withColumnRenamed("rank_final", "rank"), "hybrid": lambda: self.hybrid().withColumnRenamed("rank_final", "rank")}[system]()
        return self.once(f"metrics {system}", lambda: metrics.per_query(self.queries(), found, self.qrels()))

    def paired(self) -> DataFrame:
        return metrics.paired({s: self.metrics(s) for s in ("rag", "entity", "hybrid")})

    def judgements(self, version: int = 0) -> DataFrame:
        """Gradings of answers, made from conversation turns: lengths stand for counts and grades; some sums of claims are wrong."""
        n = F.length(F.coalesce(F.col("text"), F.lit("")))
        total = (n % 7).cast("long")
        part = F.least(total, n % 5).cast("long")
        quiet = total == 0
        grade = lambda k: F.when(~quiet, (5 - F.pmod(n + k + version, F.lit(4)) % 3).cast("int"))
        return self.table("conversations").select(
            F.col("conv_id").alias("query_id"), F.concat_ws("_", "role", F.col("turn").cast("string")).alias("system"), total.alias("total_claims"), part.alias("supported_claims"), (total - part + F.when(n % 11 == 0, 1).otherwise(0)).alias("unsupported_claims"),
            grade(0).alias("relevance"), grade(1).alias("completeness"), grade(2).alias("correctness"), (n % 3 > 0).alias("context_sufficient"), quiet.alias("response_abstained"),
        )
