"""DuckDB forms of the engine's tables: common table expressions that the oracles start from."""

WEIGHTS = "('TEM_AREA', 0.10), ('TEM_TEMA', 0.35), ('TEM_SUBTEMA', 0.45), ('INDEXADO_POR', 0.50), ('CITA', 0.35), ('TEM_AUTOR_TESE', 0.10), ('TEM_TIPO_PROCESSO', 0.10)"

BASE = rf"""
WITH chunk AS (SELECT doc_id, chunk_index, (doc_id * 3 + chunk_index * 7) % (SELECT count(*) FROM embeddings) AS vec_id FROM documents CROSS JOIN (VALUES (0::BIGINT), (1::BIGINT)) v(chunk_index)),
vec AS (SELECT doc_id, chunk_index, label, embedding FROM chunk JOIN embeddings USING (vec_id)),
q AS (SELECT vec_id AS query_id, 's' || (vec_id % 3) AS source, label AS q_label, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
pool AS (SELECT query_id, q_label, (query_id * 13 + k * 37) % (SELECT count(*) FROM documents) AS doc_id FROM q CROSS JOIN range(200) t(k) UNION SELECT query_id, q_label, doc_id FROM q JOIN chunk ON vec_id = query_id WHERE query_id % 200 <> 0),
qrel AS (SELECT query_id, doc_id, count(*) FILTER (label = q_label)::INT AS grade FROM pool JOIN vec USING (doc_id) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, chunk_index, list_inner_product(q::DOUBLE[], embedding::DOUBLE[]) AS score FROM vec CROSS JOIN q),
chunk_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS cr FROM scored),
rag_first AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY cr) AS n FROM chunk_rank WHERE cr <= 200),
rag AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cr) AS rank, doc_id, chunk_index, score FROM rag_first WHERE n = 1) WHERE rank <= 10),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, max(score) AS score FROM scored GROUP BY ALL)),
doc AS (SELECT doc_id, lang AS area, source AS tema, 'band ' || (n_chars // 1000) AS subtema, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{14,}}') AS conceitos,
  regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{12,13}}|[0-9]{{3}}') AS refs, quality, toxic FROM (SELECT doc_id, CASE WHEN doc_id % 97 <> 5 THEN lang END AS lang, CASE WHEN doc_id % 97 <> 5 THEN source END AS source, CASE WHEN doc_id % 97 <> 5 THEN n_chars END AS n_chars,
  CASE WHEN doc_id % 97 <> 5 THEN text END AS text, CASE WHEN doc_id % 97 <> 5 THEN quality END AS quality, CASE WHEN doc_id % 97 <> 5 THEN toxic END AS toxic FROM documents LEFT JOIN labels USING (doc_id))),
refs AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(refs) AS w FROM doc)),
link AS (
  SELECT doc_id, 'area' AS kind, area AS nome, 'area::' || area AS id, 'TEM_AREA' AS tipo FROM doc WHERE area IS NOT NULL
  UNION ALL SELECT doc_id, 'tema', tema, 'tema::' || area || '::' || tema, 'TEM_TEMA' FROM doc WHERE area IS NOT NULL
  UNION ALL SELECT doc_id, 'subtema', subtema, 'subtema::' || area || '::' || tema || '::' || replace(subtema, ' ', '_'), 'TEM_SUBTEMA' FROM doc WHERE area IS NOT NULL
  UNION ALL SELECT doc_id, 'autor', 'autor ' || quality, 'autor::autor_' || quality, 'TEM_AUTOR_TESE' FROM doc WHERE quality IS NOT NULL
  UNION ALL SELECT doc_id, 'tipo_processo', 'tipo ' || toxic, 'tipo_processo::tipo_' || toxic, 'TEM_TIPO_PROCESSO' FROM doc WHERE toxic IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, 'conceito', w, 'conceito::' || w, 'INDEXADO_POR' FROM (SELECT doc_id, unnest(conceitos) AS w FROM doc)
  UNION ALL SELECT doc_id, 'referencia_legal', w, 'referencia_legal::' || w, 'CITA' FROM refs),
edge AS (SELECT DISTINCT 'documento::' || doc_id AS origem, id AS destino, tipo FROM link
  UNION SELECT 'area::' || area, 'tema::' || area || '::' || tema, 'POSSUI_TEMA' FROM doc WHERE area IS NOT NULL
  UNION SELECT 'tema::' || area || '::' || tema, 'subtema::' || area || '::' || tema || '::' || replace(subtema, ' ', '_'), 'POSSUI_SUBTEMA' FROM doc WHERE area IS NOT NULL),
node AS (SELECT 'documento::' || doc_id AS node_id, 'documento' AS tipo, NULL::VARCHAR AS nome, doc_id FROM documents UNION ALL SELECT id, min(kind), min(nome), NULL FROM link GROUP BY id),
deg AS (SELECT node_id, count(*) AS degree FROM (SELECT origem AS node_id FROM edge UNION ALL SELECT destino FROM edge) GROUP BY ALL),
weight(tipo, w) AS (VALUES {WEIGHTS}),
typed AS (SELECT edge.*, w FROM edge JOIN weight USING (tipo)),
freq AS (SELECT destino, freq, ln(1 + n / (1 + freq)) AS idf FROM (SELECT destino, count(DISTINCT origem) AS freq FROM typed GROUP BY ALL) CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM documents)),
reached AS (SELECT query_id, doc_id AS seed, destino, tipo, score * w * idf AS part FROM (SELECT *, 'documento::' || doc_id AS origem FROM sem WHERE rank <= 10) JOIN typed USING (origem) JOIN freq USING (destino)),
expanded AS (SELECT query_id, replace(origem, 'documento::', '')::BIGINT AS doc_id, sum(part) AS score FROM reached JOIN typed USING (destino, tipo) GROUP BY ALL),
gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank_graph FROM expanded),
fused AS (SELECT query_id, doc_id, s.rank AS rank_semantic, s.score AS score_semantic, rank_graph, g.score AS score_graph, coalesce(1 / (60 + s.rank), 0) AS rrf_semantic, coalesce(1 / (60 + rank_graph), 0) AS rrf_graph, coalesce(s.rank <= 10, false) AS was_seed
  FROM (SELECT query_id, doc_id FROM gr UNION SELECT query_id, doc_id FROM sem WHERE rank <= 10) LEFT JOIN gr g USING (query_id, doc_id) LEFT JOIN sem s USING (query_id, doc_id)),
entity AS (SELECT * FROM (SELECT *, rrf_semantic + rrf_graph AS score_final, row_number() OVER (PARTITION BY query_id ORDER BY rrf_semantic + rrf_graph DESC, doc_id) AS rank_final FROM fused) WHERE rank_final <= 10),
met AS (SELECT query_id, doc_id, r.rank AS rank_rag, g.rank_final AS rank_entity, coalesce(1 / (60 + r.rank), 0) AS rrf_rag, coalesce(1 / (60 + g.rank_final), 0) AS rrf_entity FROM rag r FULL JOIN entity g USING (query_id, doc_id)),
hybrid AS (SELECT * FROM (SELECT *, rrf_rag + rrf_entity AS score_final, CASE WHEN rank_rag IS NULL THEN 'entity' WHEN rank_entity IS NULL THEN 'rag' ELSE 'ambos' END AS origin,
  row_number() OVER (PARTITION BY query_id ORDER BY rrf_rag + rrf_entity DESC, rank_rag NULLS LAST, rank_entity NULLS LAST, doc_id) AS rank_final FROM met) WHERE rank_final <= 10),
result AS (SELECT 'rag' AS system, query_id, doc_id, rank FROM rag UNION ALL SELECT 'entity', query_id, doc_id, rank_final FROM entity UNION ALL SELECT 'hybrid', query_id, doc_id, rank_final FROM hybrid),
ideal AS (SELECT query_id, sum(CASE WHEN i <= 10 THEN (2 ** grade - 1) / log2(i + 1) ELSE 0 END) AS idcg, count(*) FILTER (grade > 0) AS n_relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM qrel) GROUP BY ALL),
hit AS (SELECT system, query_id, count(*) FILTER (grade > 0) AS n_hits, count(grade) AS n_judged, min(rank) FILTER (grade > 0) AS first_relevant, sum(CASE WHEN grade > 0 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS dcg
  FROM result LEFT JOIN qrel USING (query_id, doc_id) GROUP BY ALL),
metric AS (SELECT s.system, q.query_id, q.source, coalesce(n_hits, 0) / 10 AS p_at_10, coalesce(n_hits / nullif(n_relevant, 0), 0) AS r_at_10, coalesce(1 / first_relevant, 0) AS mrr_at_10, coalesce(dcg / nullif(idcg, 0), 0) AS ndcg_at_10,
  coalesce(n_judged, 0) / 10 AS judged_at_10, coalesce(n_hits, 0) AS n_hits, coalesce(n_judged, 0) AS n_judged, coalesce(n_relevant, 0) AS n_relevant, first_relevant
  FROM q CROSS JOIN (VALUES ('rag', 0), ('entity', 1), ('hybrid', 2)) s(system, place) LEFT JOIN hit ON hit.system = s.system AND hit.query_id = q.query_id LEFT JOIN ideal ON ideal.query_id = q.query_id),
tall AS (UNPIVOT (SELECT system, query_id, source, p_at_10, r_at_10, mrr_at_10, ndcg_at_10 FROM metric) ON p_at_10, r_at_10, mrr_at_10, ndcg_at_10 INTO NAME metric VALUE value),
place(system, place) AS (VALUES ('rag', 0), ('entity', 1), ('hybrid', 2)),
pair AS (SELECT a.system || '_vs_' || b.system AS comparison, a.query_id, a.source, a.metric, a.value AS value_a, b.value AS value_b, b.value - a.value AS delta
  FROM tall a JOIN tall b ON a.query_id = b.query_id AND a.metric = b.metric JOIN place pa ON pa.system = a.system JOIN place pb ON pb.system = b.system AND pa.place < pb.place),
place_in_pair AS (SELECT *, row_number() OVER (PARTITION BY comparison, metric ORDER BY query_id) - 1 AS i, count(*) OVER (PARTITION BY comparison, metric) AS n FROM pair),
draw AS (SELECT p.*, d AS draw, ('0x' || substr(md5('42:' || d || ':' || i), 1, 8))::BIGINT AS h FROM place_in_pair p CROSS JOIN range(10000) t(d)),
judge AS (SELECT conv_id AS query_id, role || '_' || turn AS system, (n % 7)::BIGINT AS total_claims, least(n % 7, n % 5)::BIGINT AS supported_claims, (n % 7 - least(n % 7, n % 5) + CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END)::BIGINT AS unsupported_claims,
  CASE WHEN n % 7 > 0 THEN (5 - (n % 4) % 3)::INT END AS relevance, CASE WHEN n % 7 > 0 THEN (5 - ((n + 1) % 4) % 3)::INT END AS completeness, CASE WHEN n % 7 > 0 THEN (5 - ((n + 2) % 4) % 3)::INT END AS correctness,
  n % 3 > 0 AS context_sufficient, n % 7 = 0 AS response_abstained FROM (SELECT *, length(coalesce(text, '')) AS n FROM conversations))
"""
