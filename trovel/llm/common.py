"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Hashable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share: spark.checkpoint.dir. One of our own is set only where the session
    names none and all runs on this machine, as in tests; on a cluster without that setting, an error tells so."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='trovel-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store with all that is in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder: what follows neither repeats the work above nor
    depends on the executors that did it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def batches(source: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most so many rows, so that long texts never meet in one Python list."""
    for batch in source:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_kept: dict[Hashable, dict] = {}


def alone(operator: Hashable) -> dict:
    """What a worker process keeps for an operator over its tasks. Workers outlive stages, so the caches of all stages would
    add up in the executor's memory: those of any other operator are freed first, and their pages given back."""
    if operator not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()  # caches and what fills them refer to one another
            pa.default_memory_pool().release_unused()
            getattr(ctypes.CDLL(None), "malloc_trim", bool)(0)  # glibc alone has it
        _kept[operator] = {}
    return _kept[operator]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; others, whatever they are called, can't clash."""
    return df.select(*[F.col(f"`{given}`").alias(own) for own, given in columns.items()])


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), of any one type that has an order; root is the component's smallest node.

    Large-star and small-star rounds in turn: each links a node's neighbours to the smallest of them, until only stars
    are left. A round costs two grouped minima and two joins, which AQE splits where a node has very many neighbours.
    Null ends are dropped, loops yield the node itself, repeated edges count once, no edges yield no rows.
    """
    spark = edges.sparkSession
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        links = cut(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root")).unionByName(loops).groupBy("node").agg(F.min("root").alias("root"))
