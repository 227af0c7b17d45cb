"""Table operators: profiles, histograms, latest rows, differences, expectations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovel.functions.text import trim_ws


def existing(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """The wanted columns that exist."""
    return df.select(*[c for c in wanted if c in df.columns])


def first_existing(df: DataFrame, candidates: Iterable[str], required: bool = True) -> str | None:
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of {list(candidates)} in {df.columns}")
    return found


def normalize_columns(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Renames the columns that have an alias; two that would get one name are an error."""
    names = [aliases.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns would repeat: {names}")
    return df.withColumnsRenamed({c: aliases[c] for c in df.columns if c in aliases})


def describe(df: DataFrame, columns: list[str], percentiles: tuple[float, ...] = (0.25, 0.5, 0.75), by: list[str] | None = None) -> DataFrame:
    """Long rows (by, metric, n, mean, std, min, p…, max), exact linear percentiles, nulls left out; one pass."""
    stack = df.unpivot(list(by or []), columns, "metric", "value")
    aggs = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min")]
    aggs += [F.percentile("value", p).alias(f"p{round(100 * p):02d}") for p in percentiles]
    return stack.groupBy(*(by or []), "metric").agg(*aggs, F.max("value").alias("max"))


def value_counts(df: DataFrame, c: str, *, keep_null: bool = True) -> DataFrame:
    rows = df if keep_null else df.where(F.col(c).isNotNull())
    return rows.groupBy(c).agg(F.count("*").alias("n"))


def with_share(counts: DataFrame, c: str = "n") -> DataFrame:
    """Adds the share of the whole, by a one-row total."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum(c).alias("whole")))).withColumn("share", F.col(c) / F.col("whole")).drop("whole")


def buckets(value: Column, bounds: list[tuple[str, int, int | None]]) -> Column:
    """The name of the first range, both ends in it, that holds the value."""
    out = None
    for name, low, high in bounds:
        test = (value >= low) & (value <= high if high is not None else F.lit(True))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_rows, n_null, n_blank, n_distinct: all columns in one aggregate."""
    aggs = [F.count("*").alias("n_rows")]
    for c in columns:
        s = F.col(c).cast("string")
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__n_null"), F.count_if(trim_ws(s) == "").alias(f"{c}__n_blank"), F.count_distinct(F.col(c)).alias(f"{c}__n_distinct")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n_rows"), *[F.col(f"{c}__{k}").alias(k) for k in ("n_null", "n_blank", "n_distinct")]) for c in columns]))
    return one.select(rows.alias("r")).select("r.*")


def top_values(df: DataFrame, c: str, n: int = 15) -> DataFrame:
    return value_counts(df, c, keep_null=True).orderBy(F.desc("n"), F.col(c).asc_nulls_last()).limit(n)


def examples(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """column_name, example: the n least distinct values of each column as text, blanks and nulls left out."""
    def least(c: str) -> DataFrame:
        text = F.col(f"`{c}`").cast("string")
        return df.select(F.lit(c).alias("column_name"), text.alias("example")).where(trim_ws(F.col("example")) != "").distinct().orderBy("example").limit(n)

    return reduce(lambda x, y: x.unionByName(y), [least(c) for c in columns])


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last record of each key."""
    name = "latest_row_number"
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(f"{name} = 1").drop(name)


def pending(wanted: DataFrame, log: DataFrame, keys: list[str], done: str = "ok") -> DataFrame:
    """Rows of wanted without a record of status ok in the log; errors are tried again."""
    return wanted.join(log.where(F.col("status") == done), keys, "left_anti")


def seeded_order(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Rows in an order that a seed fixes."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys)


def set_changes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: kept, removed (only in a) or new (only in b)."""
    rows = a.select(*keys, F.lit(1).alias("in_a")).join(b.select(*keys, F.lit(1).alias("in_b")), keys, "full_outer")
    return rows.select(*keys, F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), "kept").when(F.col("in_a").isNotNull(), "removed").otherwise("new").alias("change"))


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """side, n: keys that only one of two tables has."""
    one = lambda x, y, side: x.select(*keys).distinct().join(y.select(*keys), keys, "left_anti").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return one(a, b, "only_a").unionByName(one(b, a, "only_b"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def expect_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def expect_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if found := duplicate_keys(df, keys).take(3):
        raise ValueError(f"keys {keys} repeat: {found}")
    return df


def expect_same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    if any(r.n for r in key_differences(a, b, keys).collect()):
        raise ValueError(f"tables differ in {keys}")


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of tables with the same, unique keys."""
    expect_unique(a, keys), expect_unique(b, keys), expect_same_keys(a, b, keys)
    return a.join(b, keys)


def check_vectors(vectors: DataFrame, key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """n_rows, n_keys, n_null, n_sizes: a sound vector table has as many keys as rows, no null and one size."""
    return vectors.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.count_if(F.col(embedding).isNull()).alias("n_null"), F.count_distinct(F.size(embedding)).alias("n_sizes"))


def seeded_places(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """df with place, from 1: that of seeded_order over all rows. Rows are counted by the first three digits of their hash, so a
    window reads 1/4096 of them and no task sorts all."""
    rows = df.withColumn("place_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))).withColumn("place_part", F.substring("place_hash", 1, 3))
    counts = rows.groupBy("place_part").agg(F.count("*").alias("n"))
    before = counts.withColumn("place_before", F.sum("n").over(Window.orderBy("place_part")) - F.col("n")).drop("n")  # of 4,096 rows
    own = F.row_number().over(Window.partitionBy("place_part").orderBy("place_hash", *keys))
    return rows.join(F.broadcast(before), "place_part").withColumn("place", (F.col("place_before") + own).cast("long")).drop("place_hash", "place_part", "place_before")


def next_work(work: DataFrame, log: DataFrame, keys: list[str], *, order: list[str], limit: int | None = None, seed: int = 42) -> DataFrame:
    """The work that the log has not as done, in seeded order, only the first limit rows of it if asked: rows that failed come
    again, since only status ok counts as done."""
    rows = seeded_order(pending(work, log, keys), order, seed)
    return rows if limit is None else rows.limit(limit)


def require_equal(df: DataFrame, c: str, wanted: str) -> DataFrame:
    """The rows whose text equals wanted, white space trimmed and case left out; an error that lists values if there are none."""
    found = df.where(F.lower(trim_ws(F.col(c))) == wanted.strip().lower())
    if not found.take(1):
        known = [r[0] for r in df.select(c).distinct().orderBy(c).limit(20).collect()]
        raise ValueError(f"no {c} is {wanted!r}; there are {known}")
    return found


def require_rows(df: DataFrame, keys: list[str], at_least: int = 1, exactly: int | None = None) -> DataFrame:
    """df, after a check that every group of keys has at least (or exactly) so many rows; an error names the first that has not."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    if bad := sizes.where(F.col("n") != exactly if exactly is not None else F.col("n") < at_least).orderBy(*keys).limit(3).collect():
        raise ValueError(f"groups of a wrong size: {[tuple(r) for r in bad]}")
    return df
