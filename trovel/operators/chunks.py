"""Sliding token windows, and their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovel.functions.text import words
from trovel.providers import Tokenizer


def windows(docs: DataFrame, *, size: int = 480, overlap: int = 80, prefix: str = "passage: ", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_index, chunk_id, text, num_tokens: windows of size tokens that overlap; the last ends with the text. No
    tokens make no window. Tokens are runs without white space; token_windows takes those of a model."""
    step = size - overlap
    n = F.size("tokens")
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    rows = docs.select("doc_id", words(F.col(text_col)).alias("tokens")).withColumn("count", count).where("count > 0")
    pieces = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.slice("tokens", i * step + 1, size))  # each window alone is copied
    rows = rows.select("doc_id", F.posexplode(pieces).alias("chunk_index", "piece"))
    return rows.select("doc_id", "chunk_index", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.concat(F.lit(prefix), F.array_join("piece", " ")).alias("text"), F.size("piece").alias("num_tokens"))


def token_windows(docs: DataFrame, tokenizer: Tokenizer, *, size: int = 480, overlap: int = 80, prefix: str = "passage: ", text_col: str = "text") -> DataFrame:
    """windows() by the tokens of a model: encoded, cut and decoded by it. Null texts and those of no tokens make no window."""
    step, kind = size - overlap, dict(docs.dtypes)["doc_id"]

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["t"], strict=True):
                found = tokenizer.encode(text) if text is not None else []
                for k in range(0 if not found else 1 if len(found) <= size else -(-(len(found) - size) // step) + 1):
                    piece = found[k * step : k * step + size]
                    out.append((doc_id, k, f"{doc_id}_{k}", prefix + tokenizer.decode(piece), len(piece)))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "chunk_id", "text", "num_tokens"])

    return docs.select("doc_id", F.col(text_col).alias("t")).mapInPandas(run, f"doc_id {kind}, chunk_index int, chunk_id string, text string, num_tokens int")


def window_counts(docs: DataFrame, *, size: int = 480, overlap: int = 80, text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_windows, without making the windows."""
    n = F.size(words(F.col(text_col))).cast("long")
    step = size - overlap
    return docs.select("doc_id", n.alias("n_tokens"), F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("long").alias("n_windows"))


def token_limit_audit(chunks: DataFrame, limit: int = 512, special: int = 2) -> DataFrame:
    total = F.col("num_tokens") + special
    return chunks.agg(F.count("*").alias("n_chunks"), F.max(total).cast("long").alias("longest"), F.count_if(total > limit).alias("n_over"))
