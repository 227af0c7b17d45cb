"""Toxicity: nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovel.llm.common import alone, batches, cut, pick

#: The bound of the fitted part: labelled examples of each class.
EXAMPLES = 2_048
#: Distinct terms of all examples, added up: the bound of the fitted part in bytes, whatever the texts' lengths.
POSTINGS = 4_000_000
NEIGHBOURS, BLOCK = 10, 256
#: Lengths of the word starts that are terms beside whole words.
STARTS = (4,)
#: The idf of the rarest terms: what fewer than one row in e^4 (55) holds weighs alike, so words seen once don't drown the rest.
RAREST = 4.0
#: A term of at least so many examples is a long list: weights of whole blocks under block maxima. Shorter ones are postings.
LONG_LIST = 256
#: Word forms whose terms a worker remembers, beside those of examples and of one text, and the longest of them; bounds its memory, never
#: changes a result.
FORMS, LONGEST = 200_000, 64
#: Texts whose neighbours are sought together, so that a block is read once for all of them, and the terms at which no further text
#: joins them, as those of very long texts are many; never changes a result.
TOGETHER, TERMS_TOGETHER = 250, 500_000

_POSITIVE, _NO_TERM = 2**62 - 1, -(2**63)
_WORD = re.compile(r"[^\W_]+")
#: Latin-1 characters by the same rule: those of no word become spaces.
_LATIN = bytes([c if _WORD.match(chr(c)) else 32 for c in range(256)])


def words(text: str) -> list[str]:
    """All words of a text, in lower case: what _WORD finds. Texts in Latin-1 are split without it, in a third of the time."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text)


def terms_of(word: str) -> tuple[str, ...]:
    """A word's terms: itself, and its starts (marked by a final *)."""
    return (word, *[word[:k] + "*" for k in STARTS if len(word) > k])


def terms(text: str) -> Counter:
    """Counts of all terms of a text, in lower case."""
    found: Counter = Counter()
    for word, n in Counter(words(text)).items():
        for term in terms_of(word):
            found[term] += n
    return found


class Forms(dict):
    """Row of each word: in rows, 1 + len(STARTS) numbers of its terms, _NO_TERM where it has fewer. A name's row is its number;
    words that are no names get rows behind, longer ones than LONGEST each time anew, and hashes below 0 for terms of no example."""

    def __init__(self, names: list[str]):
        super().__init__(zip(names, range(len(names)), strict=True))
        self.names, self.rows = names, array("q")
        for name in names:
            self.add(name)

    def add(self, word: str) -> None:
        get, found = self.get, terms_of(word)
        self.rows.extend([n if (n := get(t)) is not None else -1 - (hash(t) & _POSITIVE) for t in found])
        self.rows.extend([_NO_TERM] * (1 + len(STARTS) - len(found)))

    def __missing__(self, word: str) -> int:
        at = len(self.rows) // (1 + len(STARTS))
        self.add(word)
        if len(word) <= LONGEST:
            self[word] = at
        return at

    def of(self, text: list[str]) -> np.ndarray:
        """Numbers of the terms of all words, in order, repeats included."""
        own = len(self.names) * (1 + len(STARTS))
        if len(self.rows) >= own + FORMS * (1 + len(STARTS)):
            self.clear()
            self.update(zip(self.names, range(len(self.names)), strict=True))
            del self.rows[own:]
        at = np.fromiter(map(self.__getitem__, text), np.int64, len(text))
        found = np.frombuffer(self.rows, np.int64).reshape(-1, 1 + len(STARTS))[at].ravel()
        found.sort()
        return found[int(found.searchsorted(_NO_TERM, "right")) :]


@dataclass
class Index:
    """The labelled examples, alike ones side by side. Terms are numbered by falling number of examples: the first `long` ones
    are long lists. Postings (example, count) of term t lie from first[t] to first[t + 1]. votes and shares map a raw vote to
    the share of toxic rows near that vote."""

    names: list[str]
    idf: np.ndarray
    unseen: float
    long: int
    first: np.ndarray
    example: np.ndarray
    count: np.ndarray
    norm: np.ndarray
    toxic: np.ndarray
    ids: np.ndarray
    votes: np.ndarray
    shares: np.ndarray

    def __post_init__(self):
        self.ready = False

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__} | {"ready": False}

    def prepare(self) -> Index:
        """What follows from the rest, made once a worker: numbers of terms, weights, long lists in blocks and their maxima."""
        if self.ready:
            return self
        self.forms = Forms(self.names)
        self.blocks = max(1, -(-len(self.ids) // BLOCK))
        term, example = np.repeat(np.arange(len(self.names), dtype=np.int32), np.diff(self.first)), self.example
        weight = self.idf[term]
        weight *= self.count
        weight /= self.norm[example]
        split = int(self.first[self.long])
        self.lists = np.zeros((self.blocks, self.long, BLOCK), np.float32)
        self.lists[example[:split] // BLOCK, term[:split], example[:split] % BLOCK] = weight[:split]
        self.top = self.lists.max(2).T.copy() if self.long else np.zeros((0, self.blocks), np.float32)
        self.slack = 1e-6 + (self.long + 4) * 2.0**-23  # twice what a sum over all long lists can lose in 32 bits
        self.weight, self.visited, self.asked, self.ready = weight, 0, 0, True
        return self

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and unit weights of the terms of a whole text that some example holds; its other terms count in its norm."""
        found = self.forms.of(words(text))
        if not len(found):
            return found, np.empty(0)
        starts = np.flatnonzero(np.diff(found, prepend=found[0] - 1))
        counts, found = np.diff(starts, append=len(found)).astype(np.float64), found[starts]
        at = int(found.searchsorted(0))
        weights = counts[at:] * self.idf[found[at:]]
        norm = (float(weights @ weights) + float((counts[:at] ** 2).sum()) * self.unseen**2) ** 0.5
        return found[at:], weights / (norm or 1.0)

    def nearest(self, query: tuple[np.ndarray, np.ndarray], k: int, without: int | None = None) -> list[tuple[float, int]]:
        """nearest_of for one query."""
        return self.nearest_of([query], k, None if without is None else [without])[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query the k examples of largest cosine (to 6 decimals), then smallest number, exactly: short lists are added
        up for all examples; with the long lists' maxima that bounds each block; the long lists are read in the block of the
        largest bound, then in those blocks alone whose bound reaches the k-th best found there. A block is read for all queries
        that ask for it at once, in 32 bits; what may be among the k best by that is then summed in 64 bits, so a result doesn't
        depend on the queries beside it. without: an example that each query leaves out."""
        n, each = len(queries), np.arange(len(queries))
        heads = [int(found.searchsorted(self.long)) for found, _ in queries]
        short, own = np.zeros((n, self.blocks, BLOCK)), np.zeros((n, self.long), np.float32)
        for row, ((found, weights), h) in enumerate(zip(queries, heads, strict=True)):
            own[row, found[:h]] = weights[:h]
            start = self.first[found[h:]]
            size = self.first[found[h:] + 1] - start
            at = np.repeat(start - (np.cumsum(size) - size), size)
            at += np.arange(len(at))
            part = self.weight[at]
            part *= np.repeat(weights[h:], size)
            short[row] = np.bincount(self.example[at], part, self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        used = np.flatnonzero(own.any(0))
        own = own[:, used]
        bounds, sums = short.max(2) + own @ self.top[used], np.zeros_like(short)

        def read(asked: np.ndarray) -> None:
            for block in np.flatnonzero(asked.any(0)):
                rows = np.flatnonzero(asked[:, block])
                sums[rows, block] = short[rows, block] + own[rows] @ self.lists[block, used]
            if without is not None:
                sums.reshape(n, -1)[each, without] = 0.0
            self.visited += int(asked.sum())

        first = bounds.argmax(1)  # the best block first; then those whose bound reaches the k-th best in it
        asked = (np.arange(self.blocks) == first[:, None]) & (bounds > 0)
        read(asked)
        least = np.partition(sums[each, first], BLOCK - k, axis=1)[:, BLOCK - k] if k <= BLOCK else np.zeros(n)
        read(~asked & (bounds > 0) & (bounds + self.slack >= least[:, None]))
        self.asked += n
        short, sums = short.reshape(n, -1), sums.reshape(n, -1)
        rows, places = np.nonzero((sums > 0) & (sums >= (least - self.slack)[:, None]))
        ends, out = np.searchsorted(rows, np.arange(n + 1)), []
        for row, ((found, weights), h) in enumerate(zip(queries, heads, strict=True)):
            here = places[ends[row] : ends[row + 1]]
            if len(here) > k:
                rough = sums[row, here]
                here = here[rough >= np.partition(rough, len(here) - k)[len(here) - k] - self.slack]
            exact = np.round(short[row, here] + weights[:h] @ self.lists[here // BLOCK, found[:h, None], here % BLOCK], 6)
            by = np.lexsort((here, -exact))[:k]
            out.append([(s, j) for s, j in zip(exact[by].tolist(), here[by].tolist(), strict=True) if s > 0])
        return out

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic votes, each weighted by its cosine; 0 without neighbours."""
        whole = sum(s for s, _ in near)
        return sum(s for s, j in near if self.toxic[j]) / whole if whole else 0.0

    def score(self, text: str) -> tuple[float, list[tuple[int, float, int]]]:
        """The calibrated score and its evidence: nearest examples' ids, cosines and labels."""
        scores, evidence = self.scores([text])
        return scores.tolist()[0], [tuple(e.values()) for e in evidence.to_pylist()[0]]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, pa.ListArray]:
        """score for each text."""
        near, queries, held = [], [], 0
        for text in texts:
            queries.append(self.vector(text))
            held += len(queries[-1][0])
            if len(queries) >= TOGETHER or held >= TERMS_TOGETHER:
                near += self.nearest_of(queries, NEIGHBOURS)
                queries, held = [], 0
        near += self.nearest_of(queries, NEIGHBOURS) if queries else []
        scores = np.interp([self.vote(x) for x in near], self.votes, self.shares) if len(self.votes) else np.zeros(len(near))
        places = np.array([j for x in near for _, j in x], np.int64)
        evidence = [pa.array(self.ids[places], pa.int64()), pa.array([s for x in near for s, _ in x], pa.float64()), pa.array(self.toxic[places].astype(np.int32))]
        ends = pa.array([0, *accumulate(map(len, near))], pa.int32())
        return scores, pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(evidence, names=["doc_id", "cosine", "toxic"]))


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression of y on x by pooling neighbours that are out of order: points of the fitted line."""
    pools: list[list[float]] = []  # x low, x high, sum of y, weight
    for at in np.unique(x):
        here = x == at
        pools.append([at, at, float((y * w)[here].sum()), float(w[here].sum())])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    xs = [v for p in pools for v in ([p[0], p[1]] if p[1] > p[0] else [p[0]])]
    ys = [p[2] / p[3] for p in pools for _ in ([0, 1] if p[1] > p[0] else [0])]
    return np.array(xs), np.array(ys)


def build(examples: pa.Table, totals: tuple[int, int]) -> Index:
    """The index of examples (doc_id, toxic, terms, counts); totals: labelled rows of either class, which undo the equal numbers
    that were drawn: a term's idf is that among all labelled rows as the drawn ones tell it, ln((1 + rows) / (1 + rows with
    the term)), at most RAREST."""
    examples = examples.sort_by("doc_id").combine_chunks()
    ids, toxic = examples["doc_id"].to_numpy(), examples["toxic"].to_numpy().astype(np.int64)
    per_class = np.array([totals[c] / max(1, (toxic == c).sum()) for c in (0, 1)])
    lists, counts = examples["terms"].combine_chunks(), examples["counts"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    counts, example = counts.flatten().to_numpy().astype(np.int32), np.repeat(np.arange(len(ids), dtype=np.int32), lists.value_lengths().to_numpy())
    del examples, lists, coded  # postings lie in arrays of 32 bits from here on, as the driver holds other queries' things too
    rows, whole = np.bincount(codes, minlength=len(names)), float(sum(totals))
    order = np.argsort(-rows, kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order))
    seen = np.bincount(codes, per_class[toxic[example]], len(names))[order]
    idf = np.clip(np.log((1 + whole) / (1 + seen)), 0.0, RAREST)
    codes = number[codes]
    weight = idf[codes]
    weight *= counts
    norm = np.sqrt(np.bincount(example, weight**2, len(ids)))
    lead = np.zeros(len(ids), np.int64)  # alike examples lie side by side: by their heaviest term
    by = np.lexsort((codes, -weight, example))
    heads = np.flatnonzero(np.diff(example[by], prepend=-1))
    lead[example[by[heads]]] = codes[by[heads]]
    del by, weight
    side = np.lexsort((ids, lead))
    place = np.empty(len(side), np.int32)
    place[side] = np.arange(len(side))
    example = place[example]
    by = np.lexsort((example, codes))
    first = np.searchsorted(codes[by], np.arange(len(names) + 1))
    names = [names[k] for k in order]
    index = Index(names, idf, min(float(np.log(1 + whole)), RAREST), int((rows >= LONG_LIST).sum()), first, example[by], counts[by], np.where(norm[side] > 0, norm[side], 1.0), toxic[side], ids[side], np.empty(0), np.empty(0))
    del by, codes, counts, example
    index.prepare()
    if len(ids):
        by = np.lexsort((index.weight, index.example))
        term, weight, ends = np.repeat(np.arange(len(names), dtype=np.int32), np.diff(first))[by], index.weight[by], np.searchsorted(index.example[by], np.arange(len(ids) + 1))
        raw = np.empty(len(ids))
        for j in range(len(ids)):
            own, w = term[ends[j] : ends[j + 1]], weight[ends[j] : ends[j + 1]]
            up = np.argsort(own)
            raw[j] = round(index.vote(index.nearest((own[up], w[up]), NEIGHBOURS, without=j)), 4)
        index.votes, index.shares = monotone(raw, index.toxic.astype(float), per_class[index.toxic])
        index.shares = (index.shares * whole + 0.5) / (whole + 1)  # half a row on either side, so no score claims certainty
    return index


def fit(docs: DataFrame, labels: DataFrame, *, most_examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """Fits the index on labels (doc_id, toxic 0 or 1) and their whole texts.

    At most most_examples rows of either class are drawn, those of the smallest hash of the id; all their terms are indexed,
    whatever their class. Where their distinct terms add up to over POSTINGS, as those of very long texts do, fewer rows are
    drawn in the same order: each class as far as half of that goes, or what the other leaves, and one row at least. Only the
    drawn rows' terms and counts reach the driver. Null labels, ids and texts are left out; of an id's labels the largest
    holds, of its texts the least; no labels give an index that scores 0.
    """
    known = pick(labels, doc_id=id_col, toxic=label_col).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = cut(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    by_class = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    drawn = known.where("toxic = 0").orderBy(order, "doc_id").limit(most_examples).unionByName(known.where("toxic = 1").orderBy(order, "doc_id").limit(most_examples))
    texts = pick(docs, doc_id=id_col, text=text_col).where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")  # at most twice most_examples ids
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("toxicity")
        for batch in batches(source, 200):
            rows = [terms(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([list(c) for c in rows], pa.list_(pa.string())), pa.array([list(c.values()) for c in rows], pa.list_(pa.int64()))], names=["doc_id", "toxic", "terms", "counts"])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(counted, "doc_id long, toxic int, terms array<string>, counts array<long>")
    rows = cut(rows)
    sizes = rows.select("doc_id", "toxic", order.alias("h"), F.size("terms").alias("n")).collect()
    if sum(r.n for r in sizes) > POSTINGS:
        left, kept = POSTINGS, F.lit(False)
        for at, own in enumerate(sorted([[r for r in sizes if r.toxic == c] for c in (0, 1)], key=lambda own: sum(r.n for r in own))):
            own.sort(key=lambda r: (r.h, r.doc_id))
            ends = [n for n in accumulate(r.n for r in own) if n <= left // (2 - at)]
            left -= ends[-1] if ends else 0
            if own:
                last = own[max(1, len(ends)) - 1]
                kept |= (F.col("toxic") == last.toxic) & ((order < last.h) | (order == last.h) & (F.col("doc_id") <= last.doc_id))
        rows = rows.where(kept)
    return build(rows.toArrow(), (by_class.get(0, 0), by_class.get(1, 0)))


def score(docs: DataFrame, index: Index, *, id_col: str = "doc_id", text_col: str = "text", into: tuple[str, str] = ("score", "evidence"), extra: list[str] = ()) -> DataFrame:
    """doc_id, score, evidence (nearest examples: id, cosine, label) of every whole text, and the columns named as extra; the
    two middle ones are called as into says, where extra columns have those names.

    Null and empty texts, and texts without a term of any example, have no neighbours and the lowest score; each row is scored
    alone, so copies score alike; ties among neighbours go to the smaller number; no rows yield none. The index, whose size
    the number of examples bounds, is broadcast.
    """
    sent = [id_col, text_col, *[c for c in extra if c != text_col]]  # texts go to the workers once, and back only if asked for
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(sent)])
    shared, back = docs.sparkSession.sparkContext.broadcast(index), 1 if text_col in extra else 2
    names = ["c0", "score", "evidence", *own.columns[back:]]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("toxicity")  # the index itself goes with its broadcast
        index = shared.value.prepare()
        for batch in batches(source, 500):
            scores, evidence = index.scores([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), evidence, *batch.columns[back:]], names=names)

    rest = "".join(f", {c} {k}" for c, k in own.dtypes[back:])
    found = own.mapInArrow(run, f"c0 {own.dtypes[0][1]}, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>{rest}")
    return found.select(F.col("c0").alias("doc_id"), F.col("score").alias(into[0]), F.col("evidence").alias(into[1]), *[F.col(f"c{sent.index(c, 1)}").alias(c) for c in extra])
