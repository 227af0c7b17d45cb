"""Best-fit packing: bounded-space online best fit, the open bins in a bitset keyed by free space."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovel.llm.common import cut

#: Open bins of a packer.
OPEN_BINS = 1024
#: Pieces that one packer gets, about; so many packers' open bins meet in one packer of the second round.
GROUP_ROWS, GROUP_FAN = 32_768, 32


class BestFit:
    """Bins of a fixed capacity. An item goes where it leaves the least free space; with all bins open and none that
    fits, the fullest closes for a new one. put() returns the bin and the offset in it."""

    def __init__(self, capacity: int, most_open: int = OPEN_BINS):
        self.capacity, self.most_open, self.mask, self.open, self.made = capacity, most_open, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        taken = bins.pop()
        if not bins:
            self.mask &= ~(1 << free)
        self.open -= 1
        return taken

    def _keep(self, a_bin: int, free: int) -> None:
        if free:
            self.by_free[free].append(a_bin)
            self.mask |= 1 << free
            self.open += 1

    def put(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"an item of {length} in bins of {self.capacity}")
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            a_bin = self._take(free)
        else:
            free, a_bin = self.capacity, self.made
            self.made += 1
            if self.open >= self.most_open and length < self.capacity:
                self._take((self.mask & -self.mask).bit_length() - 1)
        self._keep(a_bin, free - length)
        return a_bin, self.capacity - free

    def left(self) -> Iterator[tuple[int, int]]:
        """Open bins with what they hold."""
        for free, bins in enumerate(self.by_free):
            for a_bin in bins:
                yield a_bin, self.capacity - free


def _packed(items: DataFrame, capacity: int, groups: int, most_open: int, keys: list[str]) -> DataFrame:
    """items (grp, length, order_key, *keys) with bin and offset (at) added; rows without keys' values and with kind 1 are
    bins still open at a group's end, and what they hold. Each group is packed by one task, in an order fixed by the rows."""
    kinds = dict(items.dtypes)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, fit = None, None

        def made(columns: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name) or [None] * n, f.type) if not isinstance(columns.get(f.name), pa.Array) else columns[f.name] for f in schema], schema=schema)

        def rest() -> pa.RecordBatch:
            left = list(fit.left())
            return made({"grp": [grp] * len(left), "bin": [b for b, _ in left], "length": [n for _, n in left], "at": [0] * len(left), "kind": [1] * len(left)}, len(left))

        schema = None
        for batch in source:
            if schema is None:
                schema = pa.schema([pa.field("grp", pa.int64()), pa.field("bin", pa.int64()), pa.field("at", pa.int64()), pa.field("length", pa.int64()), pa.field("kind", pa.int32()), *[pa.field(k, batch.schema.field(k).type) for k in keys]])
            groups_of, lengths, bins, at = batch.column("grp").to_pylist(), batch.column("length").to_pylist(), [], []
            for g, n in zip(groups_of, lengths, strict=True):
                if g != grp:
                    if fit is not None:
                        yield rest()
                    grp, fit = g, BestFit(capacity, most_open)
                b, o = fit.put(n)
                bins.append(b)
                at.append(o)
            if batch.num_rows:
                yield made({"grp": batch.column("grp"), "bin": bins, "at": at, "length": batch.column("length"), "kind": [0] * len(bins)} | {k: batch.column(k) for k in keys}, len(bins))
        if fit is not None:
            yield rest()

    dealt = items.repartition(groups, "grp").sortWithinPartitions("grp", "order_key", *keys)
    return dealt.mapInArrow(run, "grp long, bin long, at long, length long, kind int" + "".join(f", `{k}` {kinds[k]}" for k in keys))


def pack(pieces: DataFrame, keys: list[str], *, capacity: int = 2048, most_open: int = OPEN_BINS, about_rows: int, length_col: str = "length") -> DataFrame:
    """pieces' keys and length with sequence_id and offset: which sequence of at most capacity tokens holds a piece, and where.

    keys name a piece; they decide the order of packing, by hash, so a run can be repeated; pieces with equal keys are
    placed one by one. about_rows: their number, roughly, for the number of packers. Bins that a packer leaves open go to
    packers of a second round as items of their own, so few sequences stay open. Null and non-positive lengths are an
    error (a piece has a token at least); no rows yield none; other columns are ignored.
    """
    groups = max(1, -(-about_rows // GROUP_ROWS))
    order = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    items = pieces.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{length_col}`").cast("long").alias("length"), order.alias("order_key"))
    items = items.withColumn("grp", F.pmod(F.xxhash64("order_key"), F.lit(groups)).cast("long"))
    first = cut(_packed(items, capacity, groups, most_open, keys))
    left = first.where("kind = 1").select(F.col("grp").alias("grp1"), "bin", "length", F.xxhash64("grp", "bin").alias("order_key"))
    fans = -(-groups // GROUP_FAN)
    left = left.withColumn("grp", F.pmod(F.col("grp1"), F.lit(fans)).cast("long")).withColumnRenamed("bin", "bin1")
    again = _packed(left, capacity, fans, most_open, ["grp1", "bin1"]).where("kind = 0").select("grp1", "bin1", F.expr("shiftleft(1L, 62) + shiftleft(grp, 36) + bin").alias("sequence2"), F.col("at").alias("at2"))
    placed = first.where("kind = 0").join(again, (F.col("grp") == F.col("grp1")) & (F.col("bin") == F.col("bin1")), "left")
    return placed.select(*[F.col(f"`{k}`") for k in keys], "length", F.coalesce("sequence2", F.expr("shiftleft(grp, 36) + bin")).alias("sequence_id"), (F.col("at") + F.coalesce("at2", F.lit(0))).cast("long").alias("offset"))
