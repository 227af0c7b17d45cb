"""Language of pages by Bayesian evidence fusion: text, declared markup language, address suffix and smoothed host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovel.llm.common import batches, cut, pick

#: Bounds of the fitted text model: labelled documents of a language, hashed trigrams.
EXAMPLES, TRIGRAMS = 1_000, 1 << 16
#: Trigrams of a text count as so many independent observations at most; pseudo-counts of the levels of host priors and of
#: the tables of declared languages and suffixes.
EVIDENCE, PRIOR, TABLE = 30.0, 4.0, 2.0

_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>")
_TAG = re.compile(r"<[^>]*>")
_LANG = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})""")


def visible(html: str) -> str:
    """The text of markup: without scripts, styles, comments and tags."""
    import html as entities

    return entities.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", html)))


def trigrams(text: str) -> np.ndarray:
    """Hashed letter trigrams; runs of anything but letters are one space."""
    codes = np.frombuffer(" ".join(re.findall(r"[^\W\d_]+", f" {text.lower()} ")).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.empty(0, np.int64)
    h = codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)
    return ((h ^ (h >> np.uint64(15))) % np.uint64(TRIGRAMS)).astype(np.int64)


@dataclass
class TextModel:
    """log P(trigram | language), a row a language in the order of languages."""

    languages: list[str]
    table: np.ndarray

    def loglik(self, text: str) -> list[float]:
        """Log likelihoods, tempered to EVIDENCE observations at most and relative to the best; zeros for no letters."""
        found = trigrams(text)
        if not len(found) or not self.languages:
            return [0.0] * len(self.languages)
        total = self.table[:, found].sum(1) * min(1.0, EVIDENCE / len(found))
        return (total - total.max()).tolist()


def fit_text(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> TextModel:
    """Trigram model of labelled texts: at most EXAMPLES of a language, those of the smallest hash of id and text. Counts are
    summed in each task first; what reaches the driver is a table of one row of fixed size for every labelled language. Null
    texts and languages are left out."""
    own = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where("text IS NOT NULL AND lang IS NOT NULL")
    languages = sorted(r.lang for r in own.select("lang").distinct().collect())
    own = own.withColumn("h", F.xxhash64("doc_id", "text"))
    least = own.select("lang", "h").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= EXAMPLES)  # hashes alone are sorted, not texts
    place = {x: k for k, x in enumerate(languages)}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches(source, 200):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                counts.setdefault(lang, np.zeros(TRIGRAMS, np.int64))
                counts[lang] += np.bincount(trigrams(text), minlength=TRIGRAMS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([place[lang]] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], names=["lang", "trigram", "n"])

    table = np.zeros((len(languages), TRIGRAMS))
    if languages:
        drawn = own.join(F.broadcast(least.select("lang", "h").distinct()), ["lang", "h"]).select("text", "lang")
        for r in drawn.mapInArrow(run, "lang int, trigram long, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n")).collect():
            table[r.lang, r.trigram] = r.n
    return TextModel(languages, np.log((table + 0.1) / (table + 0.1).sum(1, keepdims=True)) if languages else table)


def host_parts(url: str | None) -> tuple[str, str, str]:
    """Host, its domain (the last two parts) and suffix (the last part), lower-cased; empty for none."""
    host = re.match(r"[^/?#]*", (url or "").partition("://")[2])[0].lower().rpartition("@")[2].partition(":")[0]
    parts = host.split(".")
    return host, ".".join(parts[-2:]), parts[-1]


def identify(pages: DataFrame, model: TextModel, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, language, posterior, text_language, declared, host for every row.

    The posterior of a language is proportional to P(text) P(declared | language) P(suffix | language) P(language | host).
    The tables of declared languages and suffixes, and the host priors, come from the text evidence of all pages by grouped
    sums of its probabilities; a host's prior is smoothed by its domain's, a domain's by its suffix's, that by the prior of
    all pages. A null or empty html or url leaves out its evidence; with no languages fitted, language is null; null ids are
    carried; repeated rows stay; no rows yield none; other columns are ignored.
    """
    own, size = pick(pages, page_id=id_col, url=url_col, html=html_col), len(model.languages)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches(source, 500):
            out = []
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                said = _LANG.search(html or "")
                out.append((*host_parts(url), said[1].lower() if said else "", model.loglik(visible(html or ""))))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns[:4]], pa.array(columns[4], pa.list_(pa.float64()))], names=["page_id", "host", "domain", "suffix", "declared", "ll"])

    seen = own.mapInArrow(run, f"page_id {own.dtypes[0][1]}, host string, domain string, suffix string, declared string, ll array<double>")
    total = F.aggregate("ll", F.lit(0.0), lambda a, x: a + F.exp(x))
    seen = cut(seen.withColumn("p", F.when(F.size("ll") > 0, F.transform("ll", lambda x: F.exp(x) / total)).otherwise(F.col("ll"))))
    sums = [F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(size)]
    if not size:
        return seen.select("page_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_language"), "declared", "host")

    def grouped(*keys: str) -> DataFrame:
        return seen.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.col(f"s{k}") for k in range(size)]).alias("_".join(["n", *keys])))

    def smoothed(n: str, prior: str | Column) -> Column:
        whole = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, prior, lambda x, q: (x + PRIOR * q) / (whole + PRIOR))

    everything = seen.agg(*sums).first()
    n_all = [float(x or 0.0) for x in everything]
    prior = F.array(*[F.lit((x + 1.0) / (sum(n_all) + size)) for x in n_all])
    suffixes = grouped("suffix").withColumn("q_suffix", smoothed("n_suffix", prior))
    domains = grouped("domain", "suffix").withColumnRenamed("n_domain_suffix", "n_domain").join(suffixes, "suffix").withColumn("q_domain", smoothed("n_domain", "q_suffix"))
    hosts = grouped("host", "domain").withColumnRenamed("n_host_domain", "n_host").join(domains.select("domain", "q_domain"), "domain").withColumn("q_host", smoothed("n_host", "q_domain"))
    per_language = F.array(*[F.lit(x) for x in n_all])
    table = lambda n, kinds: F.zip_with(n, per_language, lambda x, y: (x + TABLE) / (y + TABLE * F.lit(kinds)))
    declared = grouped("declared")
    kinds = seen.agg(F.count_distinct("declared").alias("d"), F.count_distinct("suffix").alias("s")).first()
    declared = declared.withColumn("w_declared", F.when(F.col("declared") == "", F.array_repeat(F.lit(1.0), size)).otherwise(table("n_declared", float(kinds.d))))
    suffixes = suffixes.withColumn("w_suffix", F.when(F.col("suffix") == "", F.array_repeat(F.lit(1.0), size)).otherwise(table("n_suffix", float(kinds.s))))
    joined = seen.join(cut(hosts.select("host", "q_host")), "host").join(cut(declared.select("declared", "w_declared")), "declared").join(cut(suffixes.select("suffix", "w_suffix")), "suffix")
    logs = F.zip_with(F.zip_with("ll", "q_host", lambda a, b: a + F.log(b)), F.zip_with("w_declared", "w_suffix", lambda a, b: F.log(a) + F.log(b)), lambda a, b: a + b)
    scored = joined.withColumn("score", logs).withColumn("best", F.array_max("score"))
    names = F.array(*[F.lit(x) for x in model.languages])
    at = lambda scores, best: names[(F.array_position(scores, best) - 1).cast("int")]
    return scored.select(
        "page_id", at("score", F.col("best")).alias("language"), (1.0 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))).alias("posterior"),
        at("ll", F.array_max("ll")).alias("text_language"), "declared", "host",
    )
