"""Corpus pipeline: quality rules, toxicity, near-duplicates, source mix, packing; each stage on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovel.llm import mixing, packing, quality, simhash, tokens, toxicity
from trovel.llm.common import cut, remove, shared_dir
from trovel.llm.queries import MIX_WEIGHTS, source_tree, toxic_index

#: Five-word shingles, 256 bits, for candidates only: at a Jaccard likeness of 0.8 about 15 % of the bits (39) differ, with a
#: spread of 5.7 bits, so the radius lies three spreads above; the bands that draw pairs together miss 0.2 % at 0.8, fewer of
#: nearer ones. Exact likeness of LIKENESS or more then decides.
BITS, RADIUS, LIKENESS = 256, 56, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the threshold table and the base rules."""
    return quality.keep(docs)


def toxicity_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.3 or more; the examples are those of the toxicity query."""
    index = toxic_index(spark, sf_dir)
    rest = [c for c in docs.columns if c != "doc_id"]
    scored = toxicity.score(docs, index, into=("toxicity_of_the_stage", "evidence_of_the_stage"), extra=rest)
    return scored.where("toxicity_of_the_stage < 0.3").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact copies and texts of LIKENESS or more, the one of the smallest doc_id; of rows that repeat an id
    and its text, one. Rows without an id stay, as nothing tells them apart."""
    found = cut(simhash.near_duplicates(docs, words=5, bits=BITS, radius=RADIUS, likeness=LIKENESS))
    rest = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    kept = docs.join(rest, "doc_id", "left_anti").select(*docs.columns)
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chooses four fifths of the tokens by the weights of domains, languages and sources, each document at most once. Null
    and empty texts have no tokens; rows of one doc_id (nulls too) are chosen or left together; no rows yield none."""
    levels, key = source_tree(), F.col("doc_id")
    counted = tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), extra=["lang", "source"])
    rows = cut(mixing.tree_rows(counted, levels, F.col("n_tokens"), key))
    found = mixing.cuts(rows, len(levels), total=0.8, weights=MIX_WEIGHTS, epochs=1, seed=17)
    return mixing.apply(docs, found, levels=levels, key=key, seed=17).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2,048: a row for each piece, with its ids' place and checksum."""
    pieces = tokens.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), max_len=2048)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, ["doc_id", "piece", "start", "ids_crc32"], capacity=2048, about_rows=docs.count())


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_scores),
    ("simhash near-dedup", near_duplicates),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Toxicity, fingerprints and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    import uuid

    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    docs = cut(docs)  # pieces' places alone, so that the stages' copies of the corpus can go
    remove(spark, folder)
    return docs
