"""SimHash near-duplicates: fingerprints, banded cells, in each cell a BK-tree whose edges are followed only within the radius;
where a likeness is asked for, its groups are candidates only and exact Jaccard decides."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovel.llm.common import batches, connected_components, cut, pick

#: Distinct fingerprints of a cell that one task takes; larger cells are searched in tiles of two such blocks.
CELL_ROWS = 50_000
#: Rows that may share a band's bits by chance, and members from which a component has trees of its own.
CELL_MEAN, CROWD = 64, 32
#: Members of a candidate group whose shingles one block holds; larger groups are compared in tiles of two such blocks.
GROUP_ROWS = 1_000
#: Links that a task holds at once while it reduces them to a forest.
FOREST_LINKS = 100_000


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of words (A-Z as a-z, ASCII white space apart), repeats included; of the whole sequence if
    there are fewer words; empty if there are none."""
    import xxhash

    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    joined, size, h = b" ".join(found), min(words, len(found)), xxhash.xxh64_intdigest
    ends = list(accumulate([len(w) + 1 for w in found]))
    starts = [0, *ends]
    return np.array([h(joined[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :])], np.uint64)  # noqa: B905  one start for each end


def fingerprint(hashes: np.ndarray, bits: int) -> bytes:
    """Big-endian; a bit is set if it is in over half the hashes. Words of 64 bits after the first mix the same hashes anew."""
    out, n = [], len(hashes)
    for k in range(bits // 64):
        h = hashes
        if k:
            h = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        total = np.zeros(64, np.int64)
        for at in range(0, n, 4096):
            total += np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * total > n).tobytes())
    return b"".join(out)


def exact_bands(bits: int, radius: int, rows: int = 0) -> list[list[int]]:
    """Bit sets such that any two fingerprints within the radius agree on all bits of one set at least: k of radius + k blocks.
    k grows with the rows, from 2, until the sets are so wide that CELL_MEAN rows at most share one's bits by chance."""
    k = 2
    while k < 6 and rows >> (k * bits // (radius + k)) > CELL_MEAN:
        k += 1
    blocks = np.array_split(np.arange(bits), radius + k)
    return [[int(x) for x in np.concatenate(some)] for some in combinations(blocks, k)]


def drawn_bands(bits: int, width: int, count: int, seed: int = 7) -> list[list[int]]:
    """Seeded bit sets, for radii too wide for exact_bands: a pair that agrees on a share s of its bits is missed with
    probability (1 - s^width)^count."""
    draw = np.random.default_rng(seed)
    return [[int(x) for x in draw.choice(bits, width, replace=False)] for _ in range(count)]


def likely_bands(bits: int, likeness: float, rows: int, miss: float = 0.002) -> list[list[int]]:
    """Seeded bit sets that draw together all but a share miss of the pairs of that Jaccard likeness. They are as wide as it
    takes for CELL_MEAN rows at most to share one's bits by chance (12 to 40 bits), so cells don't grow with the rows; how many
    there are follows from the binomial spread of the bits in which such a pair differs."""
    width = min(40, max(12, math.ceil(math.log2(max(rows, 1) / CELL_MEAN))))
    apart = math.acos(2 * likeness / (1 + likeness)) / math.pi
    chance = [math.comb(bits, d) * apart**d * (1 - apart) ** (bits - d) for d in range(bits + 1)]
    agree = [math.comb(bits - d, width) / math.comb(bits, width) for d in range(bits + 1)]
    low, high = 0, 1 << 20
    while high - low > 1:  # the least number that misses few enough
        mid = (low + high) // 2
        low, high = (low, mid) if sum(c * (1 - a) ** mid for c, a in zip(chance, agree, strict=True)) <= miss else (mid, high)
    return drawn_bands(bits, width, high)


class BKTree:
    """Children keyed by their integer Hamming distance to the parent. visited counts the nodes that searches met."""

    __slots__ = ("root", "visited")

    def __init__(self, value: int):
        self.root, self.visited = (value, {}), 0

    def add(self, value: int) -> None:
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def near(self, value: int, radius: int) -> Iterator[int]:
        """All values within the radius; only edges within the radius are followed."""
        stack = [self.root]
        while stack:
            held, children = stack.pop()
            self.visited += 1
            d = (held ^ value).bit_count()
            if d <= radius:
                yield held
            if len(children) <= 2 * radius:
                stack.extend([child for k, child in children.items() if -radius <= k - d <= radius])
            else:
                stack.extend([child for k in range(d - radius, d + radius + 1) if (child := children.get(k)) is not None])


def cell_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within the radius that join the cell's distinct values into the same components as all such links would: for each
    value one link to every component it meets. The cell's values lie in one tree. Once a component has over CROWD members,
    further ones go to a tree of its own instead, whose search ends at the first value found, so crowds cost no more."""
    links: list[tuple[int, int]] = []
    parent: dict[int, int] = {}
    size: dict[int, int] = {}
    crowds: dict[int, list[BKTree]] = {}
    tree = None

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for value in values:
        met = {root(hit): hit for hit in tree.near(value, radius)} if tree else {}
        for name, trees in crowds.items():
            if name not in met and (hit := next((h for t in trees for h in t.near(value, radius)), None)) is not None:
                met[name] = hit
        links.extend((value, hit) for hit in met.values())
        parent[value], size[value] = value, 1 + sum(size.pop(name) for name in met)
        own = [t for name in met for t in crowds.pop(name, ())]
        parent.update(dict.fromkeys(met, value))
        if size[value] > CROWD:
            if own:
                own[0].add(value)
            crowds[value] = own or [BKTree(value)]
        elif tree:
            tree.add(value)
        else:
            tree = BKTree(value)
    return links


def tree_links(fps: list[bytes], radius: int) -> list[tuple[bytes, bytes]]:
    size = len(fps[0])
    return [(a.to_bytes(size), b.to_bytes(size)) for a, b in cell_links([int.from_bytes(fp) for fp in fps], radius)]


def near_rows(fps: list[bytes], radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each fingerprint with earlier ones within the radius: its place, theirs and their distances."""
    words = np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1)
    step = max(1, 2_000_000 // len(fps))
    for low in range(0, len(fps), step):
        block = words[low : low + step]
        far = np.zeros((len(block), min(len(fps), low + step)), np.uint16)
        for k in range(words.shape[1]):
            far += np.bitwise_count(block[:, k, None] ^ words[None, : far.shape[1], k])
        rows, places = np.nonzero(far <= radius)
        met = places < rows + low
        rows, places = rows[met], places[met]
        if not len(rows):
            continue
        starts = np.flatnonzero(np.diff(rows, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            yield low + int(rows[a]), places[a:b], far[rows[a], places[a:b]]


def wide_links(fps: list[bytes], radius: int) -> list[tuple[bytes, bytes]]:
    """Like cell_links, by whole rows of distances: trees part little within radii as wide as a fifth of the bits."""
    root, links = np.arange(len(fps)), []
    for i, places, _ in near_rows(fps, radius):
        met, at = np.unique(root[places], return_index=True)
        links.extend((fps[i], fps[places[j]]) for j in at.tolist())
        root[np.isin(root[:i], met).nonzero()[0]] = met[0]
        root[i] = met[0]
    return links


def alike_links(fps: list[bytes], shingles: list[np.ndarray], radius: int, likeness: float) -> list[tuple[bytes, bytes]]:
    """Links of a Jaccard likeness of at least likeness between sorted, distinct shingles, enough to tell the components of
    all such links within the radius."""
    root, links = np.arange(len(fps)), []
    for i, places, far in near_rows(fps, radius):
        own = shingles[i]
        for j in places[np.argsort(far, kind="stable")].tolist():
            other = shingles[j]
            if root[j] == root[i] or min(len(own), len(other)) < likeness * max(len(own), len(other)) - 1e-9:
                continue
            at = own.searchsorted(other)
            both = int((own[np.minimum(at, len(own) - 1)] == other).sum()) if len(own) else 0
            if both and both >= likeness * (len(own) + len(other) - both) - 1e-9:
                links.append((fps[i], fps[j]))
                root[root == root[i]] = root[j]
    return links


def _search(cells: DataFrame, find: Callable[[list[bytes]], list[tuple[bytes, bytes]]], most: int | None) -> DataFrame:
    """cells (key, fp), sorted by key in each partition, to links (a, b); cells of over most rows come back as (key, a)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> None:
            if len(open_fps) > 1 and not large:
                out.extend((None, a, b) for a, b in find(open_fps))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["key", "a", "b"])

        out: list[tuple] = []
        open_key, open_fps, large = None, [], False
        for batch in source:
            if not batch.num_rows:
                continue
            keys, fps = batch.column(0).to_numpy(), batch.column(1)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if keys[a] != open_key:
                    done()
                    open_key, open_fps, large = int(keys[a]), [], False
                if b - a > 1 or b == len(keys) or open_fps or large:
                    open_fps.extend(fps.slice(a, b - a).to_pylist())
                if most is not None and (large or len(open_fps) > most):  # no more than that is held, however large the cell
                    out.extend((open_key, fp, None) for fp in open_fps)
                    open_fps, large = [], True
            if len(out) > 50_000:
                yield flush()
        done()
        yield flush()

    return cells.mapInArrow(run, "key long, a binary, b binary")


def near_links(prints: DataFrame, bands: list[list[int]], radius: int, links_of: Callable = tree_links, *, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fp of prints, enough to tell the components of all links that share a
    band's bits. links_of finds those of one cell."""

    def find(fps: list[bytes]) -> list[tuple[bytes, bytes]]:
        return links_of(fps, radius)

    def keyed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            fps = batch.column(0)
            bits = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
            for k, band in enumerate(bands):
                key = bits[:, band].astype(np.int64) @ (np.int64(1) << np.arange(len(band), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key | np.int64(k) << np.int64(42)), fps], names=["key", "fp"])

    cells = prints.select("fp").mapInArrow(keyed, "key long, fp binary").repartition("key").sortWithinPartitions("key")
    found = cut(_search(cells, find, cell_rows))
    links = found.where("b IS NOT NULL").select("a", "b")
    large = found.where("b IS NULL").select("key", F.col("a").alias("fp"))
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("n"))
    dealt = large.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tiles = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    return links.unionByName(_search(tiles, find, None).select("a", "b"))


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) that join the same components as those given: each task turns at most FOREST_LINKS at a time into stars
    around the least value of each of their trees, again while that at least halves their number.

    Only links within what others join already are left out, so no component changes; a group that meets in every band
    leaves a link for each member rather than one for each member and band. Repeated links and loops are dropped, no links
    yield no rows.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def root(v: bytes) -> bytes:
            while (up := parent.setdefault(v, v)) != v:
                parent[v] = parent[up]
                v = parent[v]
            return v

        def stars() -> pa.RecordBatch:
            found = [(v, r) for v in parent if (r := root(v)) != v]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        parent, held = {}, 0
        for batch in batches(source, FOREST_LINKS):
            if held + batch.num_rows > FOREST_LINKS:
                yield stars()
                held = 0
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
            held += batch.num_rows
        yield stars()

    links = cut(links.select("a", "b"))
    n = links.count()
    while True:
        tasks = max(1, math.ceil(n / FOREST_LINKS))
        links = cut(links.coalesce(tasks).mapInArrow(run, "a binary, b binary"))
        before, n = n, links.count()
        if tasks == 1 or 2 * n > before:
            return links


def verified_links(own: DataFrame, groups: DataFrame, *, words: int, bits: int, radius: int, likeness: float, group_rows: int | None = None) -> DataFrame:
    """Links (a, b) of an exact Jaccard likeness of words-word shingles of at least likeness within each candidate group.

    own has doc_id and text; groups has fp, first_id (a row of that id has that fp) and root, the group. One text of each
    fingerprint is read again; a group of over group_rows members is dealt to tiles of two blocks.
    """
    group_rows = group_rows or GROUP_ROWS
    ids = groups.select(F.col("first_id").alias("doc_id")).distinct()
    texts = own.where("doc_id IS NOT NULL").join(ids, "doc_id", "left_semi").unionByName(own.where("doc_id IS NULL"))

    def shingled(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 500):
            found = [np.unique(shingle_hashes(t, words)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(h, bits) for h in found], pa.binary()), pa.array([h.tobytes() for h in found], pa.binary())], names=["fp", "shingles"])

    sets = texts.select("text").mapInArrow(shingled, "fp binary, shingles binary").dropDuplicates(["fp"])
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("n"))
    dealt = groups.select("fp", "root").join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).join(sets, "fp")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tiles = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "shingles").repartition("key").sortWithinPartitions("key")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            found = alike_links(fps, sets, radius, likeness) if len(fps) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        open_key, fps, sets = None, [], []
        for batch in source:
            for key, fp, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != open_key:
                    yield links()
                    open_key, fps, sets = key, [], []
                fps.append(fp)
                sets.append(np.frombuffer(shingles, np.uint64))
        yield links()

    return tiles.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, words: int, bits: int, radius: int, likeness: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (binary, big-endian), component_id (the smallest doc_id reached through links within the radius), n_alike
    (rows of the component) for every row.

    With a likeness, fingerprints are those of distinct shingles, links within the radius only draw candidates together, and
    a link holds if the exact Jaccard likeness of two texts' shingles is at least that much.

    Rows are first drawn together by fingerprint, so copies cost one row. Bands are as wide as the number of distinct
    fingerprints asks (exact_bands, likely_bands). A null or empty text has fingerprint zero and is linked like any other; texts
    of fewer words than a shingle have one shingle; null ids count as the largest; repeated rows stay; no rows yield none; other
    columns are ignored.
    """
    own = pick(docs, doc_id=id_col, text=text_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            found = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            fps = [fingerprint(h if likeness is None else np.unique(h), bits) for h in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    prints = cut(own.mapInArrow(run, f"doc_id {own.dtypes[0][1]}, fp binary"))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    rows = classes.count()
    if likeness is None:
        links = near_links(classes, exact_bands(bits, radius, rows), radius)
    else:
        links = forest(near_links(classes, likely_bands(bits, likeness, rows), radius, wide_links))
    roots = connected_components(links).withColumnRenamed("node", "fp")
    if likeness is not None:
        groups = cut(classes.join(roots, "fp").select("fp", "first_id", "root"))
        links = forest(verified_links(own, groups, words=words, bits=bits, radius=radius, likeness=likeness))
        roots = connected_components(links).withColumnRenamed("node", "fp")
    linked = classes.join(roots, "fp")
    groups = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("n_alike"))
    linked = linked.join(groups, "root").select("fp", "component_id", "n_alike")
    alone = classes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first_id").alias("component_id"), F.col("n").alias("n_alike"))
    return prints.join(cut(linked.unionByName(alone)), "fp").select("doc_id", "fp", "component_id", "n_alike")
