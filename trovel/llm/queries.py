"""The opN_ queries: thin, with production parameters, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovel.llm import langid, lz_print, mixing, packing, quality, simhash, tokens, toxicity, url_filter, warc
from trovel.llm.common import cut, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = tokens.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), max_len=2048)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, ["doc_id", "piece", "start", "ids_crc32"], capacity=2048, about_rows=docs.count())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""


def op3_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_print.edited_likeness(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), langid.fit_text(table(spark, sf_dir, "documents")))


#: The contract's host rules.
HOST_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Rules of our own for urls that no host rule fits.
URL_RULES = [
    ("block", "||free-bets."), ("block", "||casino."), ("block", "/casino/"), ("block", "/poker/"), ("block", "||xxx."), ("block", "/xxx/"), ("block", "/porn/"), ("block", "-loans^"),
    ("block", "/viagra/"), ("block", "||torrent."), ("block", "/warez/"), ("block", "/keygen^"), ("block", "/wp-login.php"), ("block", "&sessionid="), ("allow", "||docs."), ("allow", "/wiki/"),
]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.host_rule(*r) for r in HOST_RULES] + [url_filter.url_rule(*r) for r in URL_RULES]
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(url, '^[^/?#]*://([^/?#]*\.)?(free-bets|casino|xxx|torrent)\.') OR regexp_matches(url, '/(casino|poker|xxx|porn|viagra|warez)/|/wp-login\.php|&sessionid=')
    OR regexp_matches(url, '(-loans|/keygen)([^\w\-.%]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM d"""


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=64, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id", "n_alike")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ 	-
]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM t),
win AS (SELECT doc_id, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM win JOIN dup USING (doc_id, g)) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(list_filter(w, lambda x: list_contains(STOPS, lower(rtrim(x, '.,;:!?')))))::BIGINT AS n_stop,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2.5 * n_words AND word_chars <= 12 * n_words AND 10 * n_symbols <= n_words AND 50 * n_stop >= n_words AND 2 * n_dup_lines <= n_lines AS kept FROM f
""".replace("STOPS", str(quality.STOP_WORDS))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def toxic_index(spark: SparkSession, sf_dir: str) -> toxicity.Index:
    return toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), toxic_index(spark, sf_dir))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


#: Weights of domains, languages and sources in a mix; others weigh 1.
MIX_WEIGHTS = {("forum",): 1.0, ("news",): 2.0, ("web",): 3.0, ("web", "en"): 2.0, ("news", "fr"): 1.5, ("forum", "en", "src0"): 0.5}
#: Which sources are forums and news; all others are web.
FORUMS, NEWS = [f"src{k}" for k in (0, 3, 6, 9)], [f"src{k}" for k in (1, 4, 7)]


def source_tree() -> list[F.Column]:
    return [F.when(F.col("source").isin(FORUMS), "forum").when(F.col("source").isin(NEWS), "news").otherwise("web"), F.col("lang"), F.col("source")]


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = cut(tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), extra=["lang", "source"]))
    mixed = mixing.mix(counted, levels=source_tree(), tokens=F.col("n_tokens"), key=F.col("doc_id"), total=0.8, weights=MIX_WEIGHTS, epochs=2)
    return mixed.select("doc_id", "mix_epoch", F.col("n_tokens").alias("mix_tokens"), F.col("mix_leaf")[0].alias("domain"), "lang", "source")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_warc, op3_lz_fingerprints, op4_language_id, op5_url_filters, op6_simhash_near_dedup, op7_quality_rules, op8_toxicity, op9_source_mix, op10_token_counts)}
ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op5_url_filters": OP5_SQL, "op7_quality_rules": OP7_SQL}
