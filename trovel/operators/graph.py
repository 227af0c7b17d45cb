"""Typed property graph as two tables: nodes (node_id, tipo, nome, …) and edges (origem, destino, tipo)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovel.functions.text import identifier, node_id, usable

#: Relations that every document should have.
EXPECTED = ("TEM_AREA", "TEM_TEMA", "TEM_SUBTEMA", "TEM_AUTOR_TESE", "TEM_TIPO_PROCESSO")
#: What a list of legal references leaves when it is split at the commas inside one.
FRAGMENTS = ("inc.", "art.", "par.", "alínea", "congresso nacional", "tcu", "presidente da república")


def build(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents (doc_id; area, tema, subtema, autor, tipo_processo; conceitos, referencias as arrays).

    Null and blank values make neither node nor edge; a theme needs an area and a subtheme both. One edge per (origin,
    target). Of entities of one id the least name stays, whatever order rows come in; documents are one per id.
    """
    names = {c: F.col(c) for c in ("area", "tema", "subtema", "autor", "tipo_processo")}
    norm = {c: identifier(x) for c, x in names.items()}
    has = {c: usable(x) for c, x in names.items()}
    has["tema"] = has["tema"] & has["area"]
    has["subtema"] = has["subtema"] & has["tema"]
    ids = {
        "area": node_id("area", norm["area"]), "tema": node_id("tema", norm["area"], norm["tema"]), "subtema": node_id("subtema", norm["area"], norm["tema"], norm["subtema"]),
        "autor": node_id("autor", norm["autor"]), "tipo_processo": node_id("tipo_processo", norm["tipo_processo"]),
    }
    kinds = {"area": "TEM_AREA", "tema": "TEM_TEMA", "subtema": "TEM_SUBTEMA", "autor": "TEM_AUTOR_TESE", "tipo_processo": "TEM_TIPO_PROCESSO"}
    entity = lambda kind, c, tipo, ok: F.when(ok, F.struct(ids[c].alias("id"), F.lit(kind).alias("kind"), names[c].alias("nome"), F.lit(tipo).alias("tipo")))
    single = F.array(*[entity(c, c, t, has[c]) for c, t in kinds.items()])
    def many(c: str, kind: str, tipo: str) -> F.Column:
        known = F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: usable(x))
        return F.transform(known, lambda x: F.struct(node_id(kind, identifier(x)).alias("id"), F.lit(kind).alias("kind"), x.alias("nome"), F.lit(tipo).alias("tipo")))

    listed = [many("conceitos", "conceito", "INDEXADO_POR"), many("referencias", "referencia_legal", "CITA")]
    doc = node_id("documento", F.col("doc_id").cast("string"))
    links = docs.where("doc_id IS NOT NULL").select(doc.alias("origem"), F.explode(F.concat(F.filter(single, lambda x: x.isNotNull()), *listed)).alias("e"))
    edges = links.select("origem", F.col("e.id").alias("destino"), F.col("e.tipo").alias("tipo"))
    parents = docs.where(has["tema"]).select(ids["area"].alias("origem"), ids["tema"].alias("destino"), F.lit("POSSUI_TEMA").alias("tipo"))
    parents = parents.unionByName(docs.where(has["subtema"]).select(ids["tema"].alias("origem"), ids["subtema"].alias("destino"), F.lit("POSSUI_SUBTEMA").alias("tipo")))
    edges = edges.unionByName(parents.distinct()).groupBy("origem", "destino").agg(F.min("tipo").alias("tipo"))
    entities = links.groupBy(F.col("e.id").alias("node_id")).agg(F.min("e.kind").alias("tipo"), F.min("e.nome").alias("nome"))
    documents = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).select(doc.alias("node_id"), F.lit("documento").alias("tipo"), F.lit(None).cast("string").alias("nome"), "doc_id")
    return documents.unionByName(entities, allowMissingColumns=True), edges


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    count = lambda df, what: df.groupBy("tipo").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "tipo", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with in- plus out-degree; both ends are counted in one pass before the join."""
    ends = edges.select(F.explode(F.array("origem", "destino")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.explode(F.array("origem", "destino")).alias("node_id")), "node_id", "left_anti")


def missing_relations(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...] = EXPECTED) -> DataFrame:
    """relation, n_missing: documents without an edge of it."""
    docs = nodes.where("tipo = 'documento'").select(F.col("node_id").alias("origem"))
    found = edges.where(F.col("tipo").isin(list(relations))).groupBy("origem").agg(*[F.max((F.col("tipo") == r).cast("int")).alias(r) for r in relations])
    sums = docs.join(found, "origem", "left").agg(*[F.sum(1 - F.coalesce(r, F.lit(0))).cast("long").alias(r) for r in relations])
    return sums.unpivot([], list(relations), "relation", "n_missing")


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """node_id, neighbour, tipo, direction of the nodes in ids (node_id)."""
    out = edges.join(ids.select(F.col("node_id").alias("origem")), "origem", "left_semi").select(F.col("origem").alias("node_id"), F.col("destino").alias("neighbour"), "tipo", F.lit("out").alias("direction"))
    back = edges.join(ids.select(F.col("node_id").alias("destino")), "destino", "left_semi").select(F.col("destino").alias("node_id"), F.col("origem").alias("neighbour"), "tipo", F.lit("in").alias("direction"))
    return out.unionByName(back)


def ego(nodes: DataFrame, edges: DataFrame, doc_id: int) -> DataFrame:
    """A document's connections by relation and name."""
    links = edges.where(F.col("origem") == f"documento::{doc_id}").join(nodes.select(F.col("node_id").alias("destino"), "nome"), "destino")
    return links.select("tipo", "nome", "destino").orderBy("tipo", "nome", "destino")


def hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """area, n_temas: themes below each area; areas without any stay."""
    areas = nodes.where("tipo = 'area'").select(F.col("node_id").alias("origem"), F.col("nome").alias("area"))
    counts = edges.where("tipo = 'POSSUI_TEMA'").groupBy("origem").agg(F.count("*").alias("n"))
    return areas.join(counts, "origem", "left").select("area", F.coalesce("n", F.lit(0)).cast("long").alias("n_temas"))


def by_degree(nodes: DataFrame, edges: DataFrame, tipo: str, n: int, largest: bool = True) -> DataFrame:
    order = F.desc("degree") if largest else F.asc("degree")
    return degree(nodes.where(F.col("tipo") == tipo), edges).select("node_id", "nome", "degree").orderBy(order, "node_id").limit(n)


def fragments(nodes: DataFrame) -> DataFrame:
    """Legal references that look like pieces of one: a stop word, or at most five characters."""
    name = F.lower(F.trim("nome"))
    return nodes.where((F.col("tipo") == "referencia_legal") & (name.isin(list(FRAGMENTS)) | (F.length(name) <= 5))).select("node_id", "nome")


def valid_subgraph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose two ends are known, and the nodes that such edges touch."""
    kept = reduce(lambda e, c: e.join(nodes.select(F.col("node_id").alias(c)), c, "left_semi"), ("origem", "destino"), edges).select("origem", "destino", "tipo")
    touched = kept.select(F.explode(F.array("origem", "destino")).alias("node_id"))
    return nodes.join(touched, "node_id", "left_semi"), kept


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One whole row per key, the first by order."""
    return df.withColumn("first_row_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("first_row_n = 1").drop("first_row_n")
