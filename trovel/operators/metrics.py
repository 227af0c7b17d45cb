"""Retrieval metrics at K with graded judgements, and paired comparison of systems."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovel.functions.scores import TOLERANCE, discounted, relative_change

METRICS = ("p_at_10", "r_at_10", "mrr_at_10", "ndcg_at_10")
#: Draws that a row of work makes, and numbers that the exact tests draw at once; they never change a result.
DRAWS, DRAWN = 100, 2_000_000


def largest_grades(qrels: DataFrame) -> DataFrame:
    """A (query, document) judged more than once has its largest grade."""
    return qrels.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """results with grade (null if not judged), judged, relevant."""
    out = results.join(largest_grades(qrels), ["query_id", "doc_id"], "left")
    return out.withColumns({"judged": F.col("grade").isNotNull(), "relevant": F.coalesce(F.col("grade") > 0, F.lit(False))})


def ideal(qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, idcg over all judgements, n_relevant."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    rows = largest_grades(qrels).withColumn("i", rank)
    return rows.groupBy("query_id").agg(F.sum(F.when(F.col("i") <= k, discounted(F.col("grade"), F.col("i"))).otherwise(0.0)).alias("idcg"), F.count_if(F.col("grade") > 0).alias("n_relevant"))


def per_query(queries: DataFrame, results: DataFrame, qrels: DataFrame, k: int = 10, rank: str = "rank") -> DataFrame:
    """For every query, found or not: precision over K, recall, reciprocal rank, nDCG, share and number judged, relevant."""
    r = F.col(rank)
    rows = judged(results.where(r <= k), qrels).groupBy("query_id").agg(
        F.count_if("relevant").alias("n_hits"), F.count_if("judged").alias("n_judged"), F.min(F.when(F.col("relevant"), r)).alias("first_relevant"),
        F.sum(F.when(F.col("relevant"), discounted(F.col("grade"), r)).otherwise(0.0)).alias("dcg"),
    )
    out = queries.select("query_id", "source").join(rows, "query_id", "left").join(ideal(qrels, k), "query_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "query_id", "source", (n("n_hits") / k).alias("p_at_10"), F.coalesce(n("n_hits") / F.nullif(F.col("n_relevant"), F.lit(0)), F.lit(0.0)).alias("r_at_10"),
        F.coalesce(1 / F.col("first_relevant"), F.lit(0.0)).alias("mrr_at_10"), F.coalesce(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0)), F.lit(0.0)).alias("ndcg_at_10"),
        (n("n_judged") / k).alias("judged_at_10"), n("n_hits").alias("n_hits"), n("n_judged").alias("n_judged"), n("n_relevant").alias("n_relevant"), "first_relevant",
    )


def by_source(metrics: DataFrame) -> DataFrame:
    """scope (global or source), grp, n_queries and the means: one rollup."""
    means = [F.avg(m).alias(m) for m in (*METRICS, "judged_at_10")]
    rows = metrics.rollup("source").agg(F.grouping("source").alias("g"), F.count("*").alias("n_queries"), *means)
    return rows.select(F.when(F.col("g") == 1, "global").otherwise("source").alias("scope"), F.when(F.col("g") == 1, "all").otherwise(F.col("source")).alias("grp"), "n_queries", *METRICS, "judged_at_10")


def long_form(wide: DataFrame) -> DataFrame:
    """(scope, grp, metric, value) rows of a wide summary."""
    return wide.unpivot(["scope", "grp"], [*METRICS, "judged_at_10"], "metric", "value")


def paired(systems: dict[str, DataFrame]) -> DataFrame:
    """comparison, a, b, query_id, source, metric, value_a, value_b, delta for each ordered pair of systems (as given)."""
    rows = None
    for name, df in systems.items():
        one = df.unpivot(["query_id", "source"], list(METRICS), "metric", "value").withColumn("system", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    place = F.create_map(*[x for k, n in enumerate(systems) for x in (F.lit(n), F.lit(k))])
    rows = rows.withColumn("place", F.element_at(place, F.col("system")))
    a, b = rows.alias("a"), rows.alias("b")
    joined = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.metric") == F.col("b.metric")) & (F.col("a.place") < F.col("b.place")))
    return joined.select(
        F.concat_ws("_vs_", "a.system", "b.system").alias("comparison"), F.col("a.system").alias("a"), F.col("b.system").alias("b"), F.col("a.query_id").alias("query_id"), F.col("a.source").alias("source"),
        F.col("a.metric").alias("metric"), F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"), (F.col("b.value") - F.col("a.value")).alias("delta"),
    )


def summary(pairs: DataFrame, keys: tuple[str, ...] = ("comparison", "metric")) -> DataFrame:
    """Means, relative change and wins of paired deltas."""
    rows = pairs.groupBy(*keys).agg(
        F.avg("value_a").alias("mean_a"), F.avg("value_b").alias("mean_b"), F.avg("delta").alias("delta"), F.count_if(F.col("delta") < -TOLERANCE).alias("wins_a"),
        F.count_if(F.col("delta") > TOLERANCE).alias("wins_b"), F.count_if(F.abs("delta") <= TOLERANCE).alias("ties"),
    )
    return rows.withColumn("change_pct", relative_change(F.col("mean_a"), F.col("delta")))


def _draws(pairs: DataFrame, draws: int, seed: int) -> DataFrame:
    """comparison, metric, draw, drawn, flipped: for each draw the mean delta of the queries drawn anew, and of all with signs
    drawn. The hash that decides draw and place is the same in any engine: md5 of seed:draw:place. The deltas, one number a query,
    go to each task, which makes DRAWS draws of a row; a hash is worked out once for all comparisons and metrics, and no row
    for each draw and query is made."""
    one = F.struct("query_id", "delta")
    deltas = pairs.groupBy("comparison", "metric").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["delta"].cast("double")).alias("delta"))
    whole = deltas.agg(F.collect_list(F.struct("comparison", "metric", "delta")).alias("pairs"))
    rows = pairs.sparkSession.range(0, draws, DRAWS).crossJoin(F.broadcast(whole))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in range(batch.num_rows):
                start, given = batch.column(0)[row].as_py(), batch.column(1).slice(row, 1).flatten()
                lists = given.field("delta")
                values = [lists.slice(k, 1).flatten().to_numpy(zero_copy_only=False) for k in range(len(lists))]
                known = [lists.slice(k, 1).flatten().is_valid().to_numpy(zero_copy_only=False) for k in range(len(lists))]
                places = [str(i).encode() for i in range(max(map(len, values), default=0))]
                made = np.arange(start, min(start + DRAWS, draws))
                h = np.empty((len(made), len(places)), ">u4")
                for at, draw in enumerate(made):
                    head = hashlib.md5(f"{seed}:{draw}:".encode())
                    digests = []
                    for place in places:
                        one = head.copy()
                        one.update(place)
                        digests.append(one.digest()[:4])
                    h[at] = np.frombuffer(b"".join(digests), ">u4")
                h = h.astype(np.int64)
                for k, (v, ok) in enumerate(zip(values, known, strict=True)):
                    j, sign, there = h[:, : len(v)] % len(v), 1 - 2 * (h[:, : len(v)] % 2), int(ok.sum())
                    v, n = np.where(ok, v, 0.0), ok[j].sum(1)
                    means = (pa.array(v[j].sum(1) / np.maximum(n, 1), mask=n == 0), pa.array((sign * v).sum(1) / max(there, 1), mask=np.full(len(made), there == 0)))
                    names = [given.field(c).take(pa.array(np.full(len(made), k))) for c in ("comparison", "metric")]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(made), *means], names=["comparison", "metric", "draw", "drawn", "flipped"])

    kinds = dict(pairs.dtypes)
    return rows.mapInArrow(run, f"comparison {kinds['comparison']}, metric {kinds['metric']}, draw long, drawn double, flipped double")


def bootstrap(pairs: DataFrame, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """comparison, metric, low, high: 95 % percentile interval of the mean delta, queries drawn anew draws times."""
    ends = _draws(pairs, draws, seed).groupBy("comparison", "metric").agg(F.percentile("drawn", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return ends.select("comparison", "metric", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def permutation(pairs: DataFrame, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """comparison, metric, p: two-sided sign-flip test of the mean delta, with one added to both counts."""
    seen = pairs.groupBy("comparison", "metric").agg(F.abs(F.avg("delta")).alias("seen"))
    flips = _draws(pairs, draws, seed).withColumn("m", F.abs("flipped"))
    return flips.join(seen, ["comparison", "metric"]).groupBy("comparison", "metric").agg(((F.count_if(F.col("m") >= F.col("seen") - TOLERANCE) + 1) / (F.count("*") + 1)).alias("p"))


def exact_tests(pairs: DataFrame, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """comparison, metric, low, high, p from numpy's own generator: the published intervals and p-values. A pair's deltas,
    one number a query, go to one task, which draws for at most DRAWN numbers at once: the generator goes on where it was."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        d = pdf.sort_values("query_id")["delta"].to_numpy()
        parts = [min(draws - at, step) for step in [max(1, DRAWN // max(1, len(d)))] for at in range(0, draws, step)]
        rng = np.random.default_rng(seed)
        means = np.concatenate([d[rng.integers(0, len(d), size=(n, len(d)))].mean(axis=1) for n in parts])
        low, high = np.percentile(means, [2.5, 97.5])
        rng = np.random.default_rng(seed)
        signs = np.array([-1.0, 1.0])
        p = (sum(int(np.sum(np.abs((rng.choice(signs, size=(n, len(d))) * d).mean(axis=1)) >= abs(d.mean()))) for n in parts) + 1) / (draws + 1)
        return pd.DataFrame({"comparison": [pdf["comparison"].iloc[0]], "metric": [pdf["metric"].iloc[0]], "low": [low], "high": [high], "p": [p]})

    return pairs.groupBy("comparison", "metric").applyInPandas(run, "comparison string, metric string, low double, high double, p double")


def timed(df: DataFrame, queries: int) -> dict[str, float]:
    """Seconds that a plan of so many queries takes, in whole and a query: all queries run at once, so none has its own."""
    import time

    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    return {"seconds": took, "seconds_a_query": took / max(1, queries)}
