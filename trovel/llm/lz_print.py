"""Lempel-Ziv phrase fingerprints: texts parsed into dictionary phrases, the phrase set hashed, minimum hashes compared."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovel.llm.common import batches, pick

#: Smallest hashes that a fingerprint keeps.
KEPT = 128
#: Rows that one task of the ordered pass gets, about, and the most ranges there are.
RANGE_ROWS, RANGES = 1_024, 4_096

#: Symbols: runs without white space, in pieces of at most 8 code points, so that texts without spaces have phrases too.
_SYMBOL = re.compile(r"\S{1,8}")


def symbols(text: str) -> list[str]:
    """What phrases are made of."""
    return _SYMBOL.findall(text)


class Parse:
    """A parse in progress: each phrase is the longest known one and a symbol more, as in LZ78. phrases holds the hashes of
    all phrases so far; a copy continues from the same place, so texts with a common start share its cost."""

    __slots__ = ("hashes", "node", "tree")

    def __init__(self, of: Parse | None = None):
        self.tree: dict = dict(of.tree) if of else {}
        self.hashes: list[int] = list(of.hashes) if of else []
        self.node = of.node if of else 0

    def feed(self, found: list[str], hashed) -> Parse:
        """Phrases are named by 64-bit hashes of their symbols in order: the trie's edges."""
        tree, node, out = self.tree, self.node, self.hashes
        for symbol in found:
            edge = (node, symbol)
            child = tree.get(edge)
            if child is None:
                tree[edge] = child = hashed(symbol, node)
                out.append(child)
                node = 0
            else:
                node = child
        self.node = node
        return self

    def smallest(self, kept: int) -> np.ndarray:
        """The kept smallest 32-bit hashes of the phrase set; a phrase left open at the end is already in the set."""
        found = np.unique((np.array(self.hashes, np.uint64) >> np.uint64(32)).astype(np.uint32))
        return found[:kept]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Jaccard likeness of two phrase sets from their smallest hashes: shared ones among the smallest of both. 1 for two
    empty sets."""
    both = np.union1d(a, b)[:kept]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def show(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u4").tobytes()).decode()


def print_of(text: str | None, kept: int = KEPT) -> np.ndarray:
    """The fingerprint of a text; null counts as empty."""
    import xxhash

    return Parse().feed(symbols(text or ""), xxhash.xxh64_intdigest).smallest(kept)


def prints(text: str, edited: str, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a text and its edited form. The parse of their common start, up to its last white space, is shared."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    if text == edited:
        return (own := print_of(text, kept)), own
    n = same_start(text, edited)
    while n and not text[n - 1].isspace():
        n -= 1
    start = Parse().feed(symbols(text[:n]), hashed)
    other = Parse(start).feed(symbols(edited[n:]), hashed)
    return start.feed(symbols(text[n:]), hashed).smallest(kept), other.smallest(kept)


def same_start(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def in_ranges(docs: DataFrame, rows: int) -> DataFrame:
    """docs (doc_id, text, hash) with part, descending ranges of doc_id of about so many rows (more, if that makes over RANGES),
    and seam: true for a copy of the first row of the next range, which ends each range (of the first range, for the last).
    Nulls come last, in ranges of their hash.

    The ranges' bounds are quantiles of the id column, looked up in two steps (a group of bounds, then one of the group), and
    the seams are each range's largest row: at most RANGES rows reach the driver.
    """
    total, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    parts = lambda n: min(RANGES, max(1, -(-n // rows)))
    known, n = docs.where("doc_id IS NOT NULL"), parts(total - nulls)
    bounds = sorted(set(known.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 and total > nulls else []), reverse=True)
    step = max(1, math.isqrt(len(bounds)))
    groups = [[int(b) for b in bounds[k : k + step]] for k in range(0, len(bounds), step)]
    above = lambda values: F.size(F.filter(values, lambda b: b > F.col("doc_id")))
    part = F.lit(0)
    if groups:
        lasts, all_of = F.array(*[F.lit(g[-1]) for g in groups]), F.array(*[F.array(*map(F.lit, g)) for g in groups])
        part = above(lasts) * step + F.coalesce(above(F.get(all_of, above(lasts))), F.lit(0))
    by_hash = F.floor((1 - (F.col("hash") / 2.0**64 + 0.5)) * parts(nulls)).cast("int")
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1) + by_hash).otherwise(part)
    dealt = docs.withColumn("part", part.cast("int"))
    first = dealt.groupBy("part").agg(F.max(F.struct("doc_id", "hash")).alias("top")).orderBy("part").collect()
    used = [r.part for r in first]
    before = {p: used[k - 1] for k, p in enumerate(used)}  # the range whose end a range's first row also stands at
    seams = docs.sparkSession.createDataFrame([(p, before[p], r.top.doc_id, r.top.hash) for p, r in zip(used, first, strict=True)] or [], "part int, to_part int, top_id long, top_hash long")
    copies = dealt.join(F.broadcast(seams), "part").where("doc_id <=> top_id AND hash = top_hash").dropDuplicates(["part"])
    copies = copies.select("doc_id", "text", "hash", F.col("to_part").alias("part"), F.lit(True).alias("seam"))
    return dealt.withColumn("seam", F.lit(False)).unionByName(copies)


def edited_likeness(docs: DataFrame, *, kept: int = KEPT, range_rows: int = RANGE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many of the next row's
    text, in descending doc_id, the first row's after the last. Rows of one id follow by a hash of their text; null ids come
    last; a null text is empty; a single row is its own next; no rows yield none; other columns are ignored. Texts are
    shuffled once, into ranges of ids, and each range is read as a stream of neighbours.
    """
    import hashlib

    own = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = in_ranges(own.withColumn("hash", F.xxhash64("text")), range_rows)
    dealt = dealt.repartition("part").sortWithinPartitions("part", "seam", F.col("doc_id").desc_nulls_last(), F.col("hash").desc())

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(doc, next_text: str) -> tuple:
            doc_id, text = doc
            n = len(text)
            m = n // 3
            edited = text[: n - m] + next_text[:m]
            a, b = prints(text, edited, kept)
            return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), a, b

        def row(done: tuple, next_print: np.ndarray) -> tuple:
            doc_id, n, sha, a, b = done
            return doc_id, n, sha, show(a), show(b), likeness(a, b, kept), likeness(a, next_print, kept)

        def rows() -> Iterator[tuple]:
            held, waiting = None, None  # the last row read, and the one before it, which lacks its neighbour's fingerprint
            for batch in batches(source, 500):
                for doc_id, text, seam in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    done = close(held, text) if held is not None else None
                    if waiting is not None:
                        yield row(waiting, done[3])
                    waiting = done
                    if seam:
                        if waiting is not None:
                            yield row(waiting, print_of(text, kept))
                        held = waiting = None
                    else:
                        held = (doc_id, text)

        out: list[tuple] = []
        for one in rows():
            out.append(one)
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return dealt.select("doc_id", "text", "seam").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
