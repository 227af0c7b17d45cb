"""Readers and writers of the engine's file formats; every read has a schema."""

from __future__ import annotations

import html
import tempfile
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of the benchmark's three files.
DOC_SCHEMA = "KEY long, NUMACORDAO string, ANOACORDAO string, COLEGIADO string, AREA string, TEMA string, SUBTEMA string, ENUNCIADO string, EXCERTO string, AUTORTESE string, FUNCAOAUTORTESE string, TIPOPROCESSO string, TIPORECURSO string, INDEXACAO string, REFERENCIALEGAL string, PARADIGMATICO string"
QUERY_SCHEMA = "ID long, TEXT string, SOURCE string"
QREL_SCHEMA = "QUERY_ID long, DOC_ID long, SCORE int, ENGINE string, RANK int"


def read_csv(spark: SparkSession, path: str, schema: str, columns: Iterable[str] | None = None) -> DataFrame:
    """CSV with a header, quotes doubled, fields that may span lines; only the named columns if given."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_rows_of(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a set of keys; an error if a key has none."""
    if found := keys.select(*on).distinct().join(df.select(*on), on, "left_anti").take(3):
        raise ValueError(f"no rows for {found}")
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def read_jsonl(spark: SparkSession, path: str, schema: str, *, strict: bool = True) -> DataFrame:
    """A record a line, blank lines skipped. Strict reading fails at a broken line; else it is kept in _corrupt_record."""
    if strict:
        return spark.read.json(path, schema=schema, mode="FAILFAST")
    return spark.read.json(path, schema=f"{schema}, _corrupt_record string", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A row (path, text) per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def literal_ids(spark: SparkSession, ids: Iterable[int], name: str = "doc_id") -> DataFrame:
    """A list of ids as a table with ranks from 1."""
    return spark.createDataFrame([(k + 1, int(x)) for k, x in enumerate(ids)], f"rank int, {name} long")


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    (df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)).parquet(path)


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """one_file is for summaries of a bounded number of rows."""
    out = flat_for_csv(df)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def write_markdown(rows: DataFrame, path: str, order: list[str], column: str = "markdown") -> None:
    """Blocks in order, as text files whose names keep the order."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.mode("overwrite").text(path, lineSep="\n\n")


def graph_html(nodes: DataFrame, edges: DataFrame, most: int = 2_000) -> str:
    """A page that lists a small graph's nodes and relations; an error beyond most of either, which a page can't show."""
    n, e = nodes.select("node_id", "tipo").orderBy("node_id").limit(most + 1).collect(), edges.select("origem", "destino", "tipo").orderBy("origem", "destino").limit(most + 1).collect()
    if len(n) > most or len(e) > most:
        raise ValueError(f"over {most} nodes or edges")
    item = lambda *x: "<li>" + html.escape(" ".join(x)) + "</li>"
    return "<!DOCTYPE html><meta charset=utf-8><title>Graph</title><ul class=nodes>" + "".join(item(r.tipo or "", r.node_id) for r in n) + "</ul><ul class=edges>" + "".join(item(f"[{r.origem}] --({r.tipo})--> [{r.destino}]") for r in e) + "</ul>"


def read_benchmark(spark: SparkSession, docs: str, queries: str, qrels: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The benchmark's three CSV files under the engine's names: documents (doc_id and its fields), queries (query_id, text,
    source), judgements (query_id, doc_id, grade); an error if a judgement names a query that is not there."""
    d = read_csv(spark, docs, DOC_SCHEMA).withColumnRenamed("KEY", "doc_id")
    q = read_csv(spark, queries, QUERY_SCHEMA).toDF("query_id", "text", "source")
    r = read_csv(spark, qrels, QREL_SCHEMA).selectExpr("QUERY_ID AS query_id", "DOC_ID AS doc_id", "SCORE AS grade")
    if found := r.join(q, "query_id", "left_anti").take(3):
        raise ValueError(f"judgements of unknown queries: {found}")
    return d, q, r


def write_vectors(df: DataFrame, path: str) -> int:
    """The vector table as Parquet; returns its rows, which read_vectors checks."""
    write_parquet(df, path)
    return df.sparkSession.read.parquet(path).count()


def read_vectors(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """All blocks of a vector table; an error if there are not so many rows, or if vectors differ in length."""
    df = spark.read.parquet(path)
    found = df.agg(F.count("*").alias("n"), F.count_distinct(F.size("embedding")).alias("sizes")).first()
    if (rows is not None and found.n != rows) or found.sizes > 1:
        raise ValueError(f"{found.n} vectors of {found.sizes} lengths where {rows} were expected")
    return df


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    write_parquet(nodes, f"{path}/nodes")
    write_parquet(edges, f"{path}/edges", by=["tipo"])


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as written; edges of one relation are a folder, so a filter by tipo reads no other."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges").select("origem", "destino", "tipo")


def rebuild_csv(spark: SparkSession, log: str, schema: str, path: str) -> int:
    """The whole CSV again from a JSONL log, lists and structs as JSON text; returns its rows."""
    df = read_jsonl(spark, log, schema)
    write_csv(df, path)
    return df.count()


def write_two_row_header(df: DataFrame, path: str, split: str = "__") -> None:
    """A summary of few rows as one CSV whose columns a__mean, a__std stand under two header rows: a, a and mean, std."""
    names = [c.partition(split) for c in df.columns]
    first = df.sparkSession.createDataFrame([tuple(c[0] for c in names), tuple(c[2] for c in names)], [f"c{k}" for k in range(len(names))]).withColumn("place", F.monotonically_increasing_id() + F.lit(-(1 << 62)))
    body = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(df.columns)]).withColumn("place", F.monotonically_increasing_id())
    first.unionByName(body).coalesce(1).sortWithinPartitions("place").drop("place").write.mode("overwrite").csv(path, header=False, quote='"', escape='"')


def table_text(df: DataFrame, most: int = 50) -> str:
    """The first rows as aligned text, for the console."""
    return df.limit(most).toPandas().to_string(index=False)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, worked out now and kept without the plan behind them, so that plans over it stay small: a reliable
    checkpoint in spark.checkpoint.dir. A session on this machine alone, as in tests, gets a folder of its own; on a cluster that
    names none the rows are persisted, with their plan."""
    sc = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='trovel-')}")
    return df.checkpoint(eager=True)
