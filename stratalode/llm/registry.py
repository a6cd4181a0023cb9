"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> module of this package that holds it
MODULES = {
    "op1_token_counts": "token_counts",
    "op2_embedding_dedup": "embedding_dedup",
    "op3_bpe_codec": "bpe_codec",
    "op4_quality_crf": "quality_crf",
    "op5_packing": "packing",
    "op6_substring_dedup": "substring_dedup",
    "op7_pii_sanitisation": "pii",
    "op8_quotation_linking": "quote_links",
    "op9_ngram_jaccard_join": "jaccard_join",
    "op10_exact_dedup": "exact_dedup",
    "op11_vector_codes": "vector_codes",
    "op12_filter_audit": "filter_audit",
    "op13_source_mix": "source_mix",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in SQL.items() if name in MODULES}


def _codes_sql(rounds: int = 4) -> str:
    """The Lloyd rounds as one CTE after the other."""
    ctes = []
    for k in range(rounds + 1):
        near = f"(SELECT p.*, entry, list_sum(list_transform(list_zip(p.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{k} c ON c.part = p.part)"
        ctes.append(f"a{k} AS MATERIALIZED (SELECT vec_id, label, part, x, min(d) AS d, arg_min(entry, d * 256 + entry) AS entry FROM {near} GROUP BY ALL)")
        if k < rounds:
            sums = f"(SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{k}, unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL)"
            means = f"(SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM {sums} GROUP BY part, entry)"
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.y, c.y) AS y FROM c{k} c LEFT JOIN {means} m ON m.part = c.part AND m.entry = c.entry)")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, q[part * (len(q) // 4) + 1 : (part + 1) * (len(q) // 4)] AS x FROM v, unnest(range(4)) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS y FROM p QUALIFY entry < 256),
{", ".join(ctes)},
b AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS sha FROM c{rounds}),
r AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM r, b"""


SQL = {
    "op2_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
m AS (SELECT a, min(b) AS low FROM reach GROUP BY a), k AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept, (SELECT CASE WHEN count(*) > 0 THEN 1.0::DOUBLE END FROM link WHERE a % 50 = 0) AS recall
FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN k ON k.a = vec_id""",
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS said FROM w, unnest(range(1, len(ws) - 18)) t(i)),
again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY said ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, k FROM again, unnest(range(i, i + 20)) t(k)),
each AS (SELECT doc_id, k, ws[k] AS word FROM w, unnest(range(1, len(ws) + 1)) t(k)),
words AS (SELECT e.doc_id, e.k, word, g.k IS NOT NULL AS gone FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.k = e.k),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (NOT gone), '') AS said FROM words GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS said FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.said = y.said AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = d.doc_id""",
    "op10_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op11_vector_codes": _codes_sql(),
    "op12_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT t.doc_id, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
 {'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
  'D': regexp_matches(text, '[#$%&*|]'), 'E': t.doc_id > min(t.doc_id) OVER (PARTITION BY text)} AS f FROM t LEFT JOIN labels l ON l.doc_id = t.doc_id),
parts AS (SELECT DISTINCT part FROM x),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
marked AS (SELECT part, good, toxic, f, count(*) AS n, list_filter(['A', 'B', 'C', 'D', 'E'], lambda l: CASE l WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails FROM x GROUP BY part, good, toxic, f),
steps AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before FROM orders, unnest(range(1, 6)) t(step)),
r AS (SELECT m.part, filter_order, step, own,
 coalesce(sum(n) FILTER (NOT list_has_any(fails, before) AND NOT list_contains(fails, own)), 0)::BIGINT AS kept,
 coalesce(sum(n) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, own)), 0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (list_has_any(fails, before) AND list_contains(fails, own)), 0)::BIGINT AS redundant,
 coalesce(sum(n) FILTER (fails = [own]), 0)::BIGINT AS unique_fails,
 coalesce(sum(n) FILTER (good AND NOT list_has_any(fails, before) AND list_contains(fails, own)), 0)::BIGINT AS good_lost,
 coalesce(sum(n) FILTER (toxic AND NOT list_has_any(fails, before) AND list_contains(fails, own)), 0)::BIGINT AS toxic_lost
 FROM marked m, steps GROUP BY m.part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
    "op13_source_mix": r"""
WITH d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source) AS k, sum(source_size) OVER ()::BIGINT AS total FROM s),
l AS (SELECT x.k, x.total - coalesce(sum(y.source_size * 3) FILTER (y.k < x.k), 0) AS p, sum(y.w) FILTER (y.k >= x.k) AS q FROM o x, o y GROUP BY x.k, x.total),
level AS (SELECT p::BIGINT AS p, q::BIGINT AS q FROM l JOIN o USING (k) WHERE p * w < 3 * source_size * q ORDER BY k LIMIT 1),
r AS (SELECT source, source_size, CASE WHEN 3 * source_size * q <= p * w THEN (3 * source_size)::DOUBLE ELSE (p * w)::DOUBLE / q::DOUBLE END AS target FROM s, (SELECT coalesce(max(p), 0) AS p, coalesce(max(q), 1) AS q FROM level)),
e AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
 ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(d.text, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656 AS u FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM e""",
}
