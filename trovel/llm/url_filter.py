"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovel.llm.common import pick

_TOKEN = re.compile(rb"[a-z0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """name as reported; verdict allow or block; regex, matched at the start of host and path (scoped) or anywhere in the
    url (else); tokens: letter-digit runs that every match holds whole."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    scoped: bool


def host_rule(verdict: str, name: str) -> Rule:
    """`example.org/es/`: that host and its subdomains, where the path starts so."""
    host, slash, path = name.partition("/")
    path = slash + path
    whole = path if not path[-1:].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", path)  # the last run may go on in the url
    tokens = tuple(t.decode() for t in _TOKEN.findall(f"{host} {whole}".lower().encode()))
    return Rule(name, verdict, rf"(?s:(?:[^/]*\.)?{re.escape(host)}{re.escape(path)})", tokens, True)


def url_rule(verdict: str, pattern: str) -> Rule:
    """`||free-bets.`, `/casino/`, `-loans^`: a literal anywhere in the url, A-Z as a-z; `||` is the start of the host or of
    one of its parts, `*` anything, `^` a character other than a letter, digit, `_`, `-`, `.` or `%`, or the end."""
    body = pattern.removeprefix("||")
    regex = r"^[^/?#]*://(?:[^/?#]*\.)?" if body != pattern else ""
    regex += "".join({"*": "(?s:.*)", "^": r"(?:[^\w\-.%]|\Z)"}.get(c) or re.escape(c) for c in body)
    edged = ("." if body != pattern else "*") + body + "*"
    tokens = tuple(m[1] for m in re.finditer(r"(?<![a-z0-9*])([a-z0-9]+)(?![a-z0-9*])", edged))
    return Rule(pattern, verdict, regex, tokens, False)


def rarest(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Each rule under the one of its tokens that the fewest urls hold; under the empty token if it has none."""
    index = defaultdict(list)
    for k, rule in enumerate(rules):
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(k)
    return dict(index)


def filter_urls(urls: DataFrame, rules: list[Rule], *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, matched (the names of all rules that fit) for every row.

    Scoped rules decide first, the longest of those that fit; else a block wins over an allow among the others; else the
    default. Token counts, for the index, are taken over all urls. A null url, or one without `://`, has an empty host and
    path and no scoped rule; rows repeat as given; null ids are carried; no rows yield none; other columns are ignored.
    """
    own = pick(urls, page_id=id_col, url=url_col)
    known = sorted({t for r in rules for t in r.tokens})
    seen = own.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate("url", _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0)))).alias("t"))
    counts = {r.t: r.n for r in seen.where(F.col("t").isin(known)).groupBy("t").agg(F.count("*").alias("n")).collect()}  # at most the rules' tokens
    index = {t.encode(): ks for t, ks in rarest(rules, counts).items()}
    after = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    parts = own.withColumn("rest", F.coalesce(after, F.lit(""))).withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    parts = parts.select("page_id", "url", F.translate("raw", _UPPER, _LOWER).alias("host"), F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), "^[^?#]*", 0).alias("path"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [re.compile(r.regex) for r in rules]
        always = index.get(b"", [])
        for batch in source:
            out = []
            for url, host, path in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")), strict=True):
                low = (url or "").encode().lower()  # A-Z only
                address, text = host + path, low.decode()
                found = {k for t in _TOKEN.findall(low) if t in index for k in index[t]}
                fits = [k for k in sorted(found.union(always)) if (tests[k].match(address) if rules[k].scoped else tests[k].search(text))]
                scoped = max((k for k in fits if rules[k].scoped), key=lambda k: len(rules[k].name), default=None)
                others = {rules[k].verdict for k in fits if not rules[k].scoped}
                verdict = rules[scoped].verdict if scoped is not None else "block" if "block" in others else "allow" if others else default
                out.append((rules[scoped].name if scoped is not None else None, verdict, [rules[k].name for k in fits]))
            rule, verdict, matched = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(matched, pa.list_(pa.string()))], names=["page_id", "host", "path", "rule", "verdict", "matched"])

    return parts.mapInArrow(run, f"page_id {own.dtypes[0][1]}, host string, path string, rule string, verdict string, matched array<string>")
