"""Items streamed past a block of queries in bounded memory: each query's best items, given items' scores, how many items come
before given ones, or every score. Nothing but what is asked for leaves a task, so no row for each query and item is shuffled.

A task gathers items into groups of about GROUP rows, in the order of their ids, and scores TILE queries against a group at
once. Items come before one another by falling key, then by their ids; NaN is the largest key, a null the least id, as in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Items of a group, queries of a tile, and pairs or rows worked on at once; bounds of memory, they never change a result.
GROUP, TILE, PAIRS = 32_768, 64, 8_192


def larger(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort keys of a falling order in which NaN comes first, for numpy.lexsort: the later one weighs more."""
    nan = np.isnan(key)
    return -np.where(nan, np.inf, key), ~nan


def lengths(v: np.ndarray) -> np.ndarray:
    """Of vectors; of those with NaN or infinite values, whose products are NaN or infinite in any order, 0."""
    with np.errstate(over="ignore", invalid="ignore"):
        found = np.sqrt((v * v).sum(1))
    return np.where(np.isfinite(found), found, 0.0)


class Vectors:
    """Keys and scores are inner products in double, added from the left; an item of several vectors has the largest. Vectors
    that are null or of another length count for nothing; an item without any is left out."""

    def __init__(self, q: np.ndarray):
        self.q, self.length = q, lengths(q) if q.ndim == 2 else np.zeros(len(q))

    def load(self, column: pa.Array) -> np.ndarray:
        """Takes a group's vectors (a list, or a list of lists, an item); the places of the items that have a sound one."""
        nested = pa.types.is_list(column.type.value_type)
        lists = column.flatten() if nested else column
        item = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy()) if nested else np.arange(len(column))
        size = self.q.shape[1] if self.q.ndim == 2 else -1
        sound = pc.fill_null(pc.equal(pc.list_value_length(lists), size), False)
        item, lists = item[sound.to_numpy(zero_copy_only=False)], lists.filter(sound)
        v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), max(size, 0))
        starts = np.flatnonzero(np.diff(item, prepend=-1))
        counts = np.diff(starts, append=len(item))
        self.levels, self.n = [], len(starts)  # of the k-th vectors: their items and values
        for k in range(int(counts.max(initial=0))):
            at = np.flatnonzero(counts > k)
            self.levels.append((at, v[starts[at] + k]))
        self.most = float(lengths(v).max(initial=0.0))
        return item[starts]

    def rough(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the queries lo to hi and all items by a matrix product, and how far from the exact ones they may lie."""
        out = self.q[lo:hi] @ self.levels[0][1].T
        for at, v in self.levels[1:]:
            if len(at) == self.n:
                np.maximum(out, self.q[lo:hi] @ v.T, out=out)
            else:
                out[:, at] = np.maximum(out[:, at], self.q[lo:hi] @ v.T)
        return out, 4 * (self.q.shape[1] + 8) * 2.0**-53 * self.length[lo:hi] * self.most + 1e-290

    def pairs(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact keys and scores of pairs of queries and items."""
        out = np.full(len(j), -np.inf)
        for k, (at, v) in enumerate(self.levels):
            place = np.full(self.n, -1)
            place[at] = np.arange(len(at))
            mine = np.flatnonzero(place[j] >= 0)
            for s in range(0, len(mine), PAIRS):
                here = mine[s : s + PAIRS]
                product, found = self.q[i[here]] * v[place[j[here]]], np.zeros(len(here))
                for d in range(product.shape[1]):
                    found += product[:, d]
                out[here] = found if k == 0 else np.maximum(out[here], found)
        return out, out

    def ahead(self, i: int, key: np.ndarray, keys: np.ndarray, places: np.ndarray, slack: float) -> np.ndarray:
        """How many items come before each of the given keys, at the places that their ids have among the group's: all whose
        rough key lies above, and of those too near to tell apart the ones whose exact key does."""
        by = np.argsort(key)
        rough = key[by]
        low, high = rough.searchsorted(keys - 2 * slack, "left"), rough.searchsorted(keys + 2 * slack, "right")
        out, sizes = len(key) - high, high - low
        if sizes.any():
            one = np.repeat(np.arange(len(keys)), sizes)
            j = by[np.arange(len(one)) - np.repeat(np.cumsum(sizes) - sizes - low, sizes)]
            exact, want = self.pairs(np.full(len(j), i), j)[0], keys[one]
            nan, known = np.isnan(exact), ~np.isnan(want)
            first = (exact > want) | nan & known | ((exact == want) | nan & ~known) & (j < places[one])
            out = out + np.bincount(one[first], minlength=len(keys))
        return out


class Links:
    """Scores are sums of what a query's seeds carry to an item's entities, keys the scores times 10^9 as whole numbers, so that
    scores alike in nine decimals tie; an item without an entity that the query reaches has no score, and the key -inf. query,
    number, part: what is carried, by the query's place in the block and the entity's number."""

    def __init__(self, query: np.ndarray, number: np.ndarray, part: np.ndarray, queries: int):
        self.keys, at = np.unique(number, return_inverse=True)
        reach = np.bincount(at, minlength=len(self.keys))
        dense = reach > max(8, queries // 50)  # entities of many queries have a row of all queries, others a list
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        own = dense[at]
        self.w, self.p = np.zeros((int(dense.sum()), queries)), np.zeros((int(dense.sum()), queries), bool)
        self.w[self.row[at[own]], query[own]], self.p[self.row[at[own]], query[own]] = part[own], True
        place = at[~own] * np.int64(queries) + query[~own]
        by = np.argsort(place)
        self.place, self.query, self.part, self.queries = place[by], query[~own][by], part[~own][by], queries

    def load(self, column: pa.Array) -> np.ndarray:
        """Takes a group's entities (a list of numbers an item); the places of the items that some query may reach."""
        item = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
        found = column.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(self.keys.searchsorted(found), len(self.keys) - 1) if len(self.keys) else np.zeros(len(found), np.int64)
        known = self.keys[at] == found if len(self.keys) else np.zeros(len(found), bool)
        item, at = item[known], at[known]
        by = np.lexsort((at, item))  # always summed in the same order
        item, at = item[by], at[by]
        items, item = np.unique(item, return_inverse=True)
        self.n, row = len(items), self.row[at]
        own, self.levels = np.flatnonzero(row >= 0), []
        starts = np.flatnonzero(np.diff(item[own], prepend=-1))
        counts = np.diff(starts, append=len(own))
        for k in range(int(counts.max(initial=0))):
            here = own[starts[counts > k] + k]
            self.levels.append((item[here], row[here]))
        self.item, self.at = item[row < 0], at[row < 0]
        return items

    def rough(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the queries lo to hi and all items; they are exact."""
        t = hi - lo
        score, reached = np.zeros((self.n, t)), np.zeros((self.n, t), bool)
        w, p = np.ascontiguousarray(self.w[:, lo:hi]), np.ascontiguousarray(self.p[:, lo:hi])
        for item, row in self.levels:
            score[item] += w[row]
            reached[item] |= p[row]
        start = self.place.searchsorted(self.at * np.int64(self.queries) + lo)
        sizes = self.place.searchsorted(self.at * np.int64(self.queries) + hi) - start
        if sizes.any():
            at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - start, sizes)
            cell = np.repeat(self.item, sizes) * np.int64(t) + self.query[at] - lo
            np.add.at(score.reshape(-1), cell, self.part[at])
            reached.reshape(-1)[cell] = True
        self.lo, self.score = lo, np.ascontiguousarray(score.T)
        key = np.rint(self.score * 1e9)
        key[~reached.T] = -np.inf
        self.key = key
        return key, np.zeros(t)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of pairs of the last tile's queries and items."""
        return self.key[i - self.lo, j], self.score[i - self.lo, j]

    def ahead(self, i: int, key: np.ndarray, keys: np.ndarray, places: np.ndarray, slack: float) -> np.ndarray:
        """How many reached items come before each of the given keys. As ties are many, key and place make one whole number."""
        found = np.flatnonzero(key > -np.inf)
        bits, most = int(len(key)).bit_length() + 1, max(np.abs(key[found]).max(initial=0.0), np.abs(keys).max(initial=0.0))
        if not most < 2.0 ** (62 - bits):  # beyond such scores, or NaN, one by one
            above = lambda k: (key[found] > k) | np.isnan(key[found]) & ~np.isnan(k)
            tied = lambda k: (key[found] == k) | np.isnan(key[found]) & np.isnan(k)
            return np.array([(above(k) | tied(k) & (found < p)).sum() for k, p in zip(keys, places, strict=True)])
        whole = np.sort((key[found].astype(np.int64) << bits) - found)
        return len(whole) - whole.searchsorted((keys.astype(np.int64) << bits) - places, "right")


def groups(source: Iterator[pa.RecordBatch], by: list[str], only: pa.Array | None = None) -> Iterator[pa.Table]:
    """The rows in groups, each in the order of its ids; with only, no other ids of the first column."""
    held, n = [], 0

    def ordered() -> pa.Table:
        table = pa.Table.from_batches(held)
        return table.take(pc.sort_indices(table.select(by), sort_keys=[(c, "ascending") for c in by], null_placement="at_start")).combine_chunks()

    for whole in source:
        for at in range(0, whole.num_rows, GROUP):
            batch = whole.slice(at, GROUP)
            batch = batch if only is None else batch.filter(pc.is_in(batch.column(by[0]), only))
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= GROUP:
                yield ordered()
                held, n = [], 0
    if held:
        yield ordered()


def loaded(source: Iterator[pa.RecordBatch], scorer: Vectors | Links, by: list[str], only: pa.Array | None = None) -> Iterator[pa.Table]:
    """The ids of each group's items that can be scored, once the scorer has them."""
    for table in groups(source, by, only):
        at = scorer.load(table.column(table.num_columns - 1).combine_chunks())
        if len(at):
            yield table.select(by).take(pa.array(at)).combine_chunks()


def rows(queries: pa.Array, i: np.ndarray, ids: pa.Table, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of (query_id, ids, values)."""
    names = ["query_id", *ids.column_names, *[f"v{k}" for k in range(len(values))]]
    table = pa.Table.from_arrays([queries.take(pa.array(i)), *ids.columns, *[pa.array(v) for v in values]], names=names)
    yield from table.combine_chunks().to_batches(max_chunksize=100_000)


def best(source: Iterator[pa.RecordBatch], scorer: Vectors | Links, queries: pa.Array, by: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """query_id, ids, key, score of the first items of each query among the task's, at most so many."""
    n = len(queries)
    least, i, key, score, ids = np.full(n, -np.inf), np.empty(0, np.int64), np.empty(0), np.empty(0), None
    for names in loaded(source, scorer, by) if n else ():
        new = []
        for lo in range(0, n, TILE):
            rough, slack = scorer.rough(lo, min(n, lo + TILE))
            passing = ~(rough < (least[lo : lo + TILE] - 2 * slack)[:, None])
            if isinstance(scorer, Links):
                passing &= rough > -np.inf
            for r in np.flatnonzero(passing.sum(1) > most):
                j = np.flatnonzero(passing[r])
                near = np.where(np.isnan(rough[r, j]), np.inf, rough[r, j])
                j = j[near >= np.partition(near, len(j) - most)[len(j) - most] - 2 * slack[r]]
                if len(j) > most:
                    j = j[np.lexsort((j, *larger(scorer.pairs(np.full(len(j), lo + r), j)[0])))[:most]]
                passing[r] = False
                passing[r, j] = True
            a, j = np.nonzero(passing)
            new.append((a + lo, j, *scorer.pairs(a + lo, j)))
        j = np.concatenate([x[1] for x in new])
        found = names.take(pa.array(j))
        ids = found if ids is None else pa.concat_tables([ids, found]).combine_chunks()
        i, key, score = (np.concatenate([old, *[x[k] for x in new]]) for old, k in ((i, 0), (key, 2), (score, 3)))
        order = np.lexsort((*larger(key), i))
        kept, last = _first(order, i, key, ids, by, most, n)
        i, key, score, ids = i[kept], key[kept], score[kept], ids.take(pa.array(kept)).combine_chunks()
        full = last >= 0
        least[full] = np.where(np.isnan(last_keys := key[last[full]]), np.inf, last_keys)
    if ids is not None and len(i):
        yield from rows(queries, i, ids, key, score)


def _first(order: np.ndarray, i: np.ndarray, key: np.ndarray, ids: pa.Table, by: list[str], most: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows among each query's first, in the order of queries and keys; and where in them the last one of each query lies
    that has so many, else -1. Rows that tie with the last are told apart by their ids."""
    start = np.searchsorted(i[order], np.arange(n + 1))
    size = np.diff(start)
    over = np.flatnonzero(size > most)
    keep = np.ones(len(order), bool)
    if len(over):
        bar = np.full(n, np.nan)
        bar[over] = key[order[start[over] + most - 1]]
        cut = np.zeros(n, bool)
        cut[over] = True
        mine, k = cut[i[order]], key[order]
        b = bar[i[order]]
        tied = mine & ((k == b) | np.isnan(k) & np.isnan(b))
        worse = mine & ~tied & (np.arange(len(order)) - start[i[order]] >= most)
        keep[worse] = False
        above = np.bincount(i[order][mine & ~tied & ~worse], minlength=n)
        at = np.flatnonzero(tied)
        table = ids.take(pa.array(order[at])).append_column("the query", pa.array(i[order[at]]))
        by_id = pc.sort_indices(table, sort_keys=[("the query", "ascending"), *[(c, "ascending") for c in by]], null_placement="at_start").to_numpy()
        at = at[by_id]
        owner = i[order[at]]
        first = np.searchsorted(owner, np.arange(n + 1))
        keep[at[np.arange(len(at)) - first[owner] >= most - above[owner]]] = False
    kept = order[keep]
    ends = np.searchsorted(i[kept], np.arange(1, n + 1))
    return kept, np.where(size >= most, ends - 1, -1)


def given(source: Iterator[pa.RecordBatch], scorer: Vectors | Links, queries: pa.Array, by: list[str], i: np.ndarray, wanted: pa.Array) -> Iterator[pa.RecordBatch]:
    """query_id, id, key, score of the wanted pairs of a query and an item, i the queries' places in order."""
    for names in loaded(source, scorer, by, wanted.unique()) if len(i) else ():
        place = pc.index_in(wanted, names.column(0).combine_chunks())
        here = np.flatnonzero(pc.is_valid(place).to_numpy(zero_copy_only=False))
        j = place.take(pa.array(here)).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo in range(0, len(queries), TILE):
            a, b = i[here].searchsorted([lo, lo + TILE])
            if a < b:
                if isinstance(scorer, Links):
                    scorer.rough(lo, min(len(queries), lo + TILE))
                key, score = scorer.pairs(i[here[a:b]], j[a:b])
                ok = key > -np.inf if isinstance(scorer, Links) else np.ones(len(key), bool)
                yield from rows(queries, i[here[a:b]][ok], names.take(pa.array(j[a:b][ok])), key[ok], score[ok])


def before(source: Iterator[pa.RecordBatch], scorer: Vectors | Links, queries: pa.Array, by: list[str], i: np.ndarray, wanted: pa.Array, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """query_id, id, and how many of the task's items come before each wanted pair, whose keys are known."""
    counts, ends = np.zeros(len(i), np.int64), i.searchsorted(np.arange(len(queries) + 1))
    for names in loaded(source, scorer, by) if len(i) else ():
        ids = names.column(0).combine_chunks()
        places = ids.null_count + ids.drop_null().to_numpy(zero_copy_only=False).searchsorted(wanted.to_numpy(zero_copy_only=False), "left")
        for lo in range(0, len(queries), TILE):
            hi = min(len(queries), lo + TILE)
            if ends[lo] < ends[hi]:
                rough, slack = scorer.rough(lo, hi)
                for q in range(lo, hi):
                    a, b = ends[q], ends[q + 1]
                    if a < b:
                        counts[a:b] += scorer.ahead(q, rough[q - lo], keys[a:b], places[a:b], slack[q - lo])
    if len(i):
        yield from rows(queries, i, pa.table({by[0]: wanted}), counts)


def every(source: Iterator[pa.RecordBatch], scorer: Links, queries: pa.Array, by: list[str], i: np.ndarray, left_out: pa.Array) -> Iterator[pa.RecordBatch]:
    """query_id, id, score of all pairs that have one, but for those left out."""
    for names in loaded(source, scorer, by) if len(queries) else ():
        place = pc.index_in(left_out, names.column(0).combine_chunks())
        here = np.flatnonzero(pc.is_valid(place).to_numpy(zero_copy_only=False))
        j = place.take(pa.array(here)).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo in range(0, len(queries), TILE):
            key, _ = scorer.rough(lo, min(len(queries), lo + TILE))
            a, b = i[here].searchsorted([lo, lo + TILE])
            key[i[here[a:b]] - lo, j[a:b]] = -np.inf
            for q in range(len(key)):
                at = np.flatnonzero(key[q] > -np.inf)
                yield from rows(queries, np.full(len(at), lo + q), names.take(pa.array(at)), scorer.score[q, at])
