"""DuckDB equivalents of the registered queries, over the same whole tables."""

from __future__ import annotations

from quillgraph.functions.text import DROPPED_TERMS
from quillgraph.plans.fixtures import GOLD_SQL

_DROPPED = ", ".join(f"'{t}'" for t in DROPPED_TERMS)


def _tokens(name: str, table: str, key: str) -> str:
    return rf"""
{name}_raw AS (SELECT {key}, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS ws FROM {table} WHERE text IS NOT NULL),
{name}_words AS (SELECT {key}, unnest(ws) AS word, unnest(range(len(ws))) AS wi FROM {name}_raw),
{name}_parts AS (SELECT {key}, wi, string_split_regex(regexp_replace(word, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '_+') AS ps FROM {name}_words),
{name}_each AS (SELECT {key}, wi, lower(unnest(ps)) AS term, unnest(range(len(ps))) AS pi FROM {name}_parts),
{name} AS (SELECT {key}, term, count(*) AS n, min(wi * 10000 + pi) AS pos FROM {name}_each WHERE length(term) >= 2 AND term NOT IN ({_DROPPED}) GROUP BY ALL)"""


DOC_TOKENS = _tokens("dt", "documents", "doc_id")
MOST_TERMS = " WHERE rk <= 64"
TERMS = DOC_TOKENS + f""",
terms AS (SELECT doc_id, term, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rk FROM dt){MOST_TERMS})"""
ASKED = _tokens("qt", "benchmark", "item_id") + """,
asked AS (SELECT item_id, term FROM qt)"""
BM25 = TERMS + "," + ASKED + """,
lens AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN terms t USING (doc_id) GROUP BY 1),
tot AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM lens),
df AS (SELECT term, count(*) AS df FROM terms GROUP BY 1),
bm AS (
    SELECT a.item_id, t.doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
    FROM asked a JOIN df USING (term) JOIN terms t USING (term) JOIN lens l ON l.doc_id = t.doc_id, tot GROUP BY 1, 2)"""
RANKED = BM25 + """,
ranked AS (SELECT * FROM (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm WHERE round(score, 6) > 0) WHERE rank <= {k})"""
REL = "rel AS (SELECT item_id, doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text))"
CHUNKS = """
ln AS (SELECT doc_id, lang, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS ls FROM documents WHERE text IS NOT NULL),
cuts AS (SELECT *, unnest(generate_series(0, 6 * CAST(ceil(greatest(len(ls) - 8, 0) / 6.0) AS INT), 6)) AS s FROM ln WHERE len(ls) > 0),
chunks AS (SELECT doc_id, lang, (s + 1)::INT AS start_line, least(s + 8, len(ls))::INT AS end_line, len(ls[s + 1:s + 8])::INT AS line_count, array_to_string(ls[s + 1:s + 8], chr(10)) AS text FROM cuts)"""
LINKS = r"""
raw AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages),
links AS (SELECT page_id, url, host, unnest(hs) AS href, unnest(range(len(hs)))::INT AS pos FROM raw)"""
SCORE = """
ix AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, caller, callee ORDER BY CASE bucket WHEN 'required' THEN 1 WHEN 'optional' THEN 2 WHEN 'runtime_only' THEN 3 ELSE 4 END DESC, pos DESC) AS nth FROM gold) WHERE nth = 1),
firsts AS (SELECT *, row_number() OVER (PARTITION BY case_id, caller, callee ORDER BY pos) AS nth FROM pred),"""
PLAIN = SCORE + """
keyed AS (SELECT *, callee AS gkey, nth > 1 AS gone FROM firsts),"""
CTOR = SCORE + r"""
spelled AS (SELECT case_id, caller, regexp_replace(callee, '\.__init__$', '') AS alias, callee FROM gold WHERE callee LIKE '%.\_\_init\_\_' ESCAPE '\'),
single AS (SELECT case_id, caller, alias, any_value(callee) AS callee FROM spelled GROUP BY 1, 2, 3 HAVING count(*) = 1),
aliases AS (SELECT s.* FROM single s ANTI JOIN ix ON ix.case_id = s.case_id AND ix.caller = s.caller AND ix.callee = s.alias),
named AS (
    SELECT f.*, CASE WHEN ix.callee IS NOT NULL THEN f.callee ELSE coalesce(a.callee, f.callee) END AS gkey
    FROM firsts f LEFT JOIN ix ON ix.case_id = f.case_id AND ix.caller = f.caller AND ix.callee = f.callee
    LEFT JOIN aliases a ON a.case_id = f.case_id AND a.caller = f.caller AND a.alias = f.callee),
keyed AS (SELECT *, nth > 1 OR row_number() OVER (PARTITION BY case_id, caller, gkey ORDER BY CASE WHEN nth > 1 THEN 1 ELSE 0 END, pos) > 1 AS gone FROM named),"""
CASE_SCORES = """
hit AS (
    SELECT k.*, ix.bucket, ix.bucket IS NOT NULL AND ix.bucket <> 'excluded' AND k.file = ix.file AND abs(k.line - ix.line) <= 0
           AND contains(regexp_replace(ix.evidence, '\\s+', ' ', 'g'), k.evidence) AS ok
    FROM keyed k LEFT JOIN ix ON ix.case_id = k.case_id AND ix.caller = k.caller AND ix.callee = k.gkey),
sums AS (
    SELECT case_id, count(*) FILTER (NOT gone) AS predicted_edges, count(*) FILTER (gone) AS duplicate_predictions,
           count(*) FILTER (NOT gone AND bucket = 'required') AS matched_required, count(*) FILTER (NOT gone AND bucket = 'optional') AS matched_optional,
           count(*) FILTER (NOT gone AND bucket = 'runtime_only') AS matched_runtime_only, count(*) FILTER (NOT gone AND bucket = 'excluded') AS matched_excluded,
           count(*) FILTER (NOT gone AND bucket IS NULL) AS unmatched_predictions, count(*) FILTER (NOT gone AND bucket = 'required' AND ok) AS okr, count(*) FILTER (NOT gone AND ok) AS oka
    FROM hit GROUP BY 1),
req AS (SELECT case_id, count(*) FILTER (bucket = 'required') AS required_edges FROM gold GROUP BY 1),
scores AS (
    SELECT c.case_id, coalesce(required_edges, 0) AS required_edges, coalesce(predicted_edges, 0) AS predicted_edges, coalesce(duplicate_predictions, 0) AS duplicate_predictions,
           coalesce(matched_required, 0) AS matched_required, coalesce(matched_optional, 0) AS matched_optional, coalesce(matched_runtime_only, 0) AS matched_runtime_only,
           coalesce(matched_excluded, 0) AS matched_excluded, coalesce(unmatched_predictions, 0) AS unmatched_predictions,
           coalesce(matched_required + matched_optional + matched_runtime_only, 0) AS accepted,
           round_even((matched_required + matched_optional + matched_runtime_only)::DOUBLE / nullif(predicted_edges, 0), 6) AS edge_precision,
           round_even(matched_required::DOUBLE / nullif(required_edges, 0), 6) AS edge_recall,
           round_even(okr::DOUBLE / nullif(matched_required, 0), 6) AS evidence_accuracy,
           round_even(oka::DOUBLE / nullif(matched_required + matched_optional + matched_runtime_only, 0), 6) AS evidence_accuracy_all
    FROM range(50) c(case_id) LEFT JOIN req USING (case_id) LEFT JOIN sums USING (case_id))"""
KEYWORD = TERMS + "," + ASKED + """,
kw AS (
    SELECT q.item_id, d.doc_id, sum(CASE WHEN t.term IS NOT NULL THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(d.text), q.term) THEN 0.25 ELSE 0.0 END)::DOUBLE AS keyword
    FROM asked q CROSS JOIN documents d LEFT JOIN terms t ON t.doc_id = d.doc_id AND t.term = q.term GROUP BY 1, 2)"""
RESPONSES = """
base AS (SELECT event_id, user_id, event_type, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)"""
MASK = r"""
conv AS (SELECT conv_id, turn, role = 'assistant' AS mine, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS ws FROM conversations),
flat AS (SELECT conv_id, mine, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS p FROM (SELECT conv_id, turn, mine, unnest(range(len(ws))) AS i FROM conv)),
size AS (SELECT conv_id, count(p) AS n FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN flat USING (conv_id) GROUP BY 1),
masked AS (
    SELECT s.conv_id, s.n::INT AS tokens, (count(*) FILTER (f.mine))::INT AS labels, least(s.n, 120)::INT AS kept, (count(*) FILTER (f.mine AND f.p > s.n - 120))::INT AS kept_labels
    FROM size s LEFT JOIN flat f USING (conv_id) GROUP BY s.conv_id, s.n)"""

ORACLES: dict[str, str] = {
    "doc_term_counts": f"WITH {DOC_TOKENS} SELECT doc_id, term, n FROM dt",
    "doc_top_terms": f"WITH {TERMS} SELECT doc_id, term, rank FROM terms WHERE rank <= 10",
    "corpus_stats": f"WITH {TERMS}, lens AS (SELECT d.doc_id, count(t.term) AS n FROM documents d LEFT JOIN terms t USING (doc_id) GROUP BY 1) SELECT count(*) AS doc_count, round_even(avg(n), 6) AS avg_doc_length, (SELECT count(DISTINCT term) FROM terms) AS unique_terms FROM lens",
    "top_df_terms": f"WITH {TERMS} SELECT term, count(*) AS doc_count FROM terms GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "line_chunks": f"WITH {CHUNKS} SELECT doc_id, start_line, end_line, line_count, length(text) AS char_count FROM chunks",
    "chunk_hash_ids": f"WITH {CHUNKS}, h AS (SELECT *, sha256(lang || chr(10) || 'c0' || chr(10) || doc_id || chr(10) || start_line || chr(10) || end_line || chr(10) || text) AS chunk_sha256 FROM chunks) SELECT doc_id, lang || ':' || doc_id || ':' || start_line || '-' || end_line || ':' || substr(chunk_sha256, 1, 12) AS chunk_id, chunk_sha256 FROM h",
    "index_limits": "WITH p AS (SELECT source, printf('%s/%08d.txt', source, doc_id) AS path FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path) AS n FROM p) SELECT source, count(*) AS files, max(path) AS last FROM r WHERE n <= 20 GROUP BY 1",
    "normalised_text": r"SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' +', ' ', 'g') AS evidence, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9_.\-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'run') AS slug, greatest(1, ceil(length(text) / 4.0))::INT AS pack_tokens, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor((length(text) + 3) / 4.0)) END::INT AS tool_tokens FROM documents",
    "path_predicates": r"WITH p AS (SELECT page_id, url, regexp_extract(url, '://(.*)$', 1) AS p FROM pages), q AS (SELECT *, list_filter(string_split(lower(p), '/'), lambda x: x <> '') AS parts FROM p) SELECT page_id, list_has_any(parts, ['tests', 'test']) OR starts_with(coalesce(parts[-1], ''), 'test_') OR ends_with(coalesce(parts[-1], ''), '_test.py') OR contains(coalesce(parts[-1], ''), '.test.') OR contains(coalesce(parts[-1], ''), '.spec.') AS is_test, list_has_any(parts, ['.venv', 'venv', 'env', 'site-packages', 'dist-packages', 'node_modules', '__pypackages__']) AS is_external, url = '' AS url_relative, NOT regexp_matches(p, '^[a-zA-Z][a-zA-Z0-9+.\-]*://') AND NOT contains(p, '<') AND NOT contains(p, '/../') AND NOT starts_with(p, '../') AND NOT regexp_matches(p, '^([A-Za-z]:)?/|^[A-Za-z]:') AS path_relative FROM q",
    "safe_ratios": "WITH g AS (SELECT l_orderkey % 1000 AS g, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_linestatus = 'X') AS x, count(*) AS n FROM lineitem GROUP BY 1) SELECT g, round_even(r::DOUBLE / n, 6) AS ratio, round_even(n::DOUBLE / nullif(x, 0), 6) AS none, round_even((n - r)::DOUBLE, 6) AS delta FROM g",
    "bm25_topk": f"WITH {RANKED.format(k=10)} SELECT item_id, doc_id, rank, score FROM ranked",
    "bm25_by_lang": f"""WITH {TERMS}, {ASKED},
        lens AS (SELECT d.doc_id, d.lang, count(t.term) AS dl FROM documents d LEFT JOIN terms t USING (doc_id) GROUP BY ALL),
        tot AS (SELECT lang, count(*) AS docs, avg(dl) AS avgdl FROM lens GROUP BY 1),
        df AS (SELECT lang, term, count(*) AS df FROM terms JOIN lens USING (doc_id) GROUP BY ALL),
        bm AS (SELECT a.item_id, l.lang, t.doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
               FROM asked a JOIN terms t USING (term) JOIN lens l ON l.doc_id = t.doc_id JOIN df ON df.term = t.term AND df.lang = l.lang JOIN tot ON tot.lang = l.lang GROUP BY ALL)
        SELECT item_id, lang, doc_id, rank, score FROM (SELECT item_id, lang, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id, lang ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm WHERE round(score, 6) > 0) WHERE rank <= 3""",
    "keyword_topk": f"WITH {KEYWORD} SELECT item_id, doc_id, rank, score FROM (SELECT item_id, doc_id, keyword AS score, row_number() OVER (PARTITION BY item_id ORDER BY keyword DESC, doc_id) AS rank FROM kw WHERE keyword > 0) WHERE rank <= 10",
    "hybrid_topk": "WITH " + (BM25 + KEYWORD[len(TERMS) + 1 + len(ASKED):]).replace(MOST_TERMS, "") + ", both_scores AS (SELECT kw.item_id, kw.doc_id, round(coalesce(score, 0) + 0.25 * keyword, 6) AS score FROM kw LEFT JOIN bm USING (item_id, doc_id)) SELECT item_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM both_scores WHERE score > 0) WHERE rank <= 10",
    "dense_topk": "WITH s AS (SELECT q.vec_id AS q_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id) SELECT q_id, vec_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5",
    "dense_label_recall": "WITH s AS (SELECT q.vec_id AS q_id, q.label AS want, v.vec_id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id) SELECT q_id, round_even((count(*) FILTER (label = want))::DOUBLE / count(*), 6) AS precision FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10 GROUP BY 1",
    "multiquery_merge": f"""WITH {BM25},
        qr AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, pos) AS r FROM qt),
        subs AS (SELECT item_id, 0 AS ord, 'eight' AS label, term FROM qr WHERE r <= 8 UNION ALL SELECT item_id, 1, 'three', term FROM qr WHERE r <= 3
                 UNION ALL SELECT item_id, 2, 'longest', term FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, term) AS l FROM qr) WHERE l = 1),
        sc AS (SELECT s.item_id, ord, label, t.doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
               FROM subs s JOIN df USING (term) JOIN terms t USING (term) JOIN lens l ON l.doc_id = t.doc_id, tot GROUP BY ALL),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, ord ORDER BY score DESC, doc_id) AS r FROM sc WHERE score > 0) WHERE r <= 50),
        merged AS (SELECT item_id, doc_id, max(score) AS score, count(DISTINCT label) AS query_count, first(label ORDER BY score DESC, label) AS best_query FROM best GROUP BY ALL)
        SELECT item_id, doc_id, rank, score, query_count::INT AS query_count, best_query FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM merged) WHERE rank <= 10""",
    "diversify_by_source": f"""WITH {RANKED.format(k=40)}, r AS (SELECT r.*, source, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS nth, max(score) OVER (PARTITION BY item_id) AS top FROM ranked r JOIN documents USING (doc_id))
        SELECT item_id, doc_id, source, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN nth = 1 AND source <> '' AND score >= 0.4 * top THEN 0 ELSE 1 END, rank) AS new_rank FROM r) WHERE new_rank <= 10""",
    "definition_slot": f"""WITH {RANKED.format(k=10)}, {REL}, cand AS (SELECT item_id, max(doc_id) AS c FROM rel GROUP BY 1),
        held AS (SELECT r.item_id, r.doc_id, r.rank, c, (SELECT rank FROM ranked x WHERE x.item_id = r.item_id AND x.doc_id = cand.c) AS old, count(*) OVER (PARTITION BY r.item_id) AS n FROM ranked r LEFT JOIN cand USING (item_id)),
        why AS (SELECT *, CASE WHEN c IS NULL THEN 'no_exact_definition_candidate' WHEN old <= 2 THEN 'already_within_slot' WHEN old IS NOT NULL THEN 'promoted_existing' ELSE 'inserted_missing' END AS slot_reason FROM held),
        moved AS (SELECT item_id, doc_id, slot_reason, CASE WHEN slot_reason = 'promoted_existing' THEN CASE WHEN doc_id = c THEN least(2, n) WHEN rank >= least(2, n) AND rank < old THEN rank + 1 ELSE rank END WHEN slot_reason = 'inserted_missing' AND rank >= least(2, n) THEN rank + 1 ELSE rank END AS p FROM why
                  UNION ALL SELECT DISTINCT item_id, c, slot_reason, least(2, n) FROM why WHERE slot_reason = 'inserted_missing')
        SELECT item_id, doc_id, new_rank, slot_reason FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p) AS new_rank FROM moved) WHERE new_rank <= 10""",
    "retrieval_eval_at_k": f"""WITH {RANKED.format(k=10)}, {REL}, e AS (SELECT rel.item_id, rel.doc_id, rank, k FROM rel LEFT JOIN ranked USING (item_id, doc_id), (VALUES (5), (10)) t(k))
        SELECT item_id AS case_id, k, count(*) AS edges, round_even((count(*) FILTER (rank <= k))::DOUBLE / count(*), 6) AS recall, round_even((count(DISTINCT doc_id) FILTER (rank <= k))::DOUBLE / count(DISTINCT doc_id), 6) AS file_recall, round_even((count(*) FILTER (rank <= k))::DOUBLE / count(*), 6) AS line_recall FROM e GROUP BY 1, 2""",
    "retrieval_mrr": f"WITH {RANKED.format(k=10)}, {REL}, m AS (SELECT item_id, count(rel.doc_id) AS n, min(rank) AS r FROM benchmark LEFT JOIN rel USING (item_id) LEFT JOIN ranked USING (item_id, doc_id) GROUP BY 1) SELECT item_id AS case_id, CASE WHEN n = 0 THEN NULL WHEN r IS NULL THEN 0.0 ELSE round_even(1.0::DOUBLE / r, 6) END AS mrr FROM m",
    "retrieval_mean_mrr": f"WITH {RANKED.format(k=10)}, {REL}, m AS (SELECT item_id, count(rel.doc_id) AS n, min(rank) AS r FROM benchmark LEFT JOIN rel USING (item_id) LEFT JOIN ranked USING (item_id, doc_id) GROUP BY 1), v AS (SELECT CASE WHEN n = 0 THEN NULL WHEN r IS NULL THEN 0.0 ELSE round_even(1.0::DOUBLE / r, 6) END AS mrr FROM m) SELECT round_even(avg(mrr), 6) AS mrr, count(mrr) AS cases FROM v",
    "definition_accuracy_at_k": f"WITH {RANKED.format(k=10)}, {REL} SELECT item_id AS case_id, k, CASE WHEN bool_and(coalesce(rank <= k, false)) THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy FROM rel LEFT JOIN ranked USING (item_id, doc_id), (VALUES (5), (10)) t(k) GROUP BY 1, 2",
    "link_edges": f"WITH {LINKS} SELECT page_id, pos, host, href FROM links",
    "link_dedupe": f"WITH {LINKS} SELECT host, count(DISTINCT href) AS links FROM links GROUP BY 1",
    "host_fanout": f"WITH {LINKS} SELECT host, count(*) AS links, count(DISTINCT href) AS targets, count(DISTINCT page_id) AS pages FROM links GROUP BY 1",
    "same_host_semi": f"WITH {LINKS}, rooted AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS section FROM pages) SELECT page_id, count(*) AS links FROM links l WHERE EXISTS (SELECT 1 FROM rooted r WHERE r.host = l.host AND r.section = regexp_extract(l.href, '^/?([^/?#]*)', 1)) GROUP BY 1",
    "dangling_links_anti": f"WITH {LINKS}, l AS (SELECT DISTINCT regexp_extract(href, '^/?([^/?#]*)', 1) AS section FROM links), r AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS section FROM pages) SELECT state, count(*) AS n FROM (SELECT 'missing' AS state FROM l ANTI JOIN r USING (section) UNION ALL SELECT 'extra' FROM r ANTI JOIN l USING (section)) GROUP BY 1",
    "two_hop_reach": "WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem), h0 AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS node FROM supplier), h1 AS (SELECT DISTINCT start, b AS node FROM h0 JOIN e ON e.a = node), h2 AS (SELECT DISTINCT start, b AS node FROM h1 JOIN e ON e.a = node), every AS (SELECT start, node, 0 AS depth FROM h0 UNION ALL SELECT start, node, 1 FROM h1 UNION ALL SELECT start, node, 2 FROM h2), best AS (SELECT start, node, min(depth) AS depth FROM every GROUP BY 1, 2) SELECT start, depth, count(*) AS n FROM best GROUP BY 1, 2",
    "edge_score_case": f"WITH {GOLD_SQL}, {PLAIN} {CASE_SCORES} SELECT * EXCLUDE (accepted) FROM scores",
    "edge_score_ctor": f"WITH {GOLD_SQL}, {CTOR} {CASE_SCORES} SELECT * EXCLUDE (accepted) FROM scores",
    "edge_score_total": f"WITH {GOLD_SQL}, {PLAIN} {CASE_SCORES} SELECT count(*) AS case_count, sum(required_edges)::BIGINT AS required_edges, sum(predicted_edges)::BIGINT AS predicted_edges, sum(matched_required)::BIGINT AS matched_required, sum(accepted)::BIGINT AS accepted_predictions, round_even(sum(accepted)::DOUBLE / nullif(sum(predicted_edges), 0), 6) AS edge_precision, round_even(sum(matched_required)::DOUBLE / nullif(sum(required_edges), 0), 6) AS edge_recall, round_even(sum(round_even(evidence_accuracy * matched_required, 0)) / nullif(sum(matched_required), 0), 6) AS evidence_accuracy FROM scores",
    "edge_score_bucket": f"WITH {GOLD_SQL}, {PLAIN} {CASE_SCORES}, n AS (SELECT *, CASE WHEN case_id % 2 = 0 THEN 'find_callees' ELSE 'find_callers' END AS task_type, ['easy', 'medium', 'hard'][(case_id % 3 + 1)::INT] AS difficulty FROM scores) SELECT task_type, difficulty, count(*) AS case_count, sum(required_edges)::BIGINT AS required_edges, sum(predicted_edges)::BIGINT AS predicted_edges, sum(matched_required)::BIGINT AS matched_required, round_even(sum(matched_required)::DOUBLE / nullif(sum(predicted_edges), 0), 6) AS edge_precision, round_even(sum(matched_required)::DOUBLE / nullif(sum(required_edges), 0), 6) AS edge_recall, round_even(sum(coalesce(round_even(evidence_accuracy * accepted, 0), 0)) / nullif(sum(accepted), 0), 6) AS evidence_accuracy FROM n GROUP BY GROUPING SETS ((task_type), (difficulty))",
    "edge_missing": f"WITH {GOLD_SQL}, {SCORE} m AS (SELECT g.case_id, g.caller || ' -> ' || g.callee AS id FROM gold g WHERE bucket = 'required' AND NOT EXISTS (SELECT 1 FROM firsts f JOIN ix ON ix.case_id = f.case_id AND ix.caller = f.caller AND ix.callee = f.callee WHERE ix.bucket = 'required' AND f.case_id = g.case_id AND f.caller = g.caller AND f.callee = g.callee)) SELECT case_id, count(*) AS n, min(id) AS first FROM m GROUP BY 1",
    "mock_golden_scores": f"WITH {GOLD_SQL}, ix AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, caller, callee ORDER BY CASE bucket WHEN 'required' THEN 1 WHEN 'optional' THEN 2 WHEN 'runtime_only' THEN 3 ELSE 4 END DESC, pos DESC) AS nth FROM gold) WHERE nth = 1), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, caller, callee ORDER BY pos) AS nth FROM gold WHERE bucket = 'required') WHERE nth = 1), h AS (SELECT p.case_id, ix.bucket, ix.bucket <> 'excluded' AND p.file = ix.file AND p.line = ix.line AS ok FROM p LEFT JOIN ix USING (case_id, caller, callee)) SELECT case_id, count(*) AS predicted_edges, count(*) FILTER (bucket = 'required') AS matched_required, round_even((count(*) FILTER (bucket <> 'excluded'))::DOUBLE / count(*), 6) AS edge_precision, round_even((count(*) FILTER (bucket = 'required' AND ok))::DOUBLE / nullif(count(*) FILTER (bucket = 'required'), 0), 6) AS evidence_accuracy FROM h GROUP BY 1",
    "evidence_match": f"WITH {GOLD_SQL} SELECT p.case_id, count(*) FILTER (abs(p.line - g.line) <= 0) AS within_0, count(*) FILTER (abs(p.line - g.line) <= 1) AS within_1, count(*) FILTER (abs(p.line - g.line) <= 2) AS within_2 FROM pred p JOIN gold g ON g.case_id = p.case_id AND g.pos = p.pos AND g.file = p.file AND contains(regexp_replace(g.evidence, '\\s+', ' ', 'g'), p.evidence) GROUP BY 1",
    "direct_call_audit": f"WITH {GOLD_SQL} SELECT case_id, count(*) AS missing FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.bucket <> 'excluded' AND g.case_id = p.case_id AND g.caller = p.caller AND g.callee = p.callee) GROUP BY 1",
    "best_per_symbol": "WITH r AS (SELECT l_orderkey % 50 AS case_id, l_suppkey, l_partkey, ['static_confirmed', 'framework_inferred', 'dynamic_possible', 'runtime_only'][l_linenumber % 4 + 1] AS confidence_type, l_linenumber % 4 AS q, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS pos FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY case_id, l_suppkey, l_partkey ORDER BY q, line, pos) AS n FROM r) SELECT case_id, confidence_type, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM b WHERE n = 1 GROUP BY 1, 2",
    "canonical_prefix": "WITH s AS (SELECT p_partkey, p_partkey % 7 AS m, p_partkey % 5 AS k, 'm' || (p_partkey % 7) || '.k' || (p_partkey % 5) || '.f' || p_partkey AS symbol FROM part) SELECT p_partkey, symbol, CASE WHEN m = 1 AND k < 3 THEN 'deep' || k || '.f' || p_partkey ELSE 'mod' || m || '.k' || k || '.f' || p_partkey END AS canonical FROM s",
    "line_in_chunk": f"WITH {CHUNKS}, p AS (SELECT DISTINCT doc_id, start_line + 3 AS line FROM chunks) SELECT p.doc_id, count(*) AS n FROM p JOIN chunks c ON c.doc_id = p.doc_id AND line BETWEEN start_line AND end_line GROUP BY 1",
    "innermost_span": f"WITH {CHUNKS}, sp AS (SELECT doc_id, start_line, end_line, printf('chunk-%06d', start_line) AS name FROM chunks UNION ALL SELECT doc_id, 1, max(end_line), 'file' FROM chunks GROUP BY 1), p AS (SELECT DISTINCT doc_id, start_line AS line FROM chunks) SELECT doc_id, line, name FROM (SELECT p.doc_id, p.line, name, row_number() OVER (PARTITION BY p.doc_id, p.line ORDER BY end_line - start_line, length(name) DESC, name) AS n FROM p JOIN sp ON sp.doc_id = p.doc_id AND line BETWEEN start_line AND end_line) WHERE n = 1",
    "interval_merge": "WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s FROM events), f AS (SELECT user_id, s, s + 1800 AS e, CASE WHEN s <= max(s + 1800) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM e), i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT user_id, min(s) AS start, max(e) AS \"end\", count(*) AS parts FROM i GROUP BY user_id, g",
    "greedy_pack": "WITH RECURSIVE d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk, greatest(1, ceil(length(text) / 4.0))::BIGINT AS t FROM documents), f AS (SELECT source, rk, doc_id, t, true AS took, t AS total, 1 AS slot FROM d WHERE rk = 1 UNION ALL SELECT d.source, d.rk, d.doc_id, d.t, f.total + d.t <= 3000, f.total + CASE WHEN f.total + d.t <= 3000 THEN d.t ELSE 0 END, f.slot + CASE WHEN f.total + d.t <= 3000 THEN 1 ELSE 0 END FROM f JOIN d ON d.source = f.source AND d.rk = f.rk + 1) SELECT source, doc_id, t AS tokens, slot FROM f WHERE took",
    "agent_call_budget": "WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM events) SELECT user_id, count(*) AS calls, count(*) FILTER (c <= 20) AS allowed, max(event_id) FILTER (c <= 20) AS last_allowed FROM e GROUP BY 1",
    "read_budgets": """WITH RECURSIVE e AS (SELECT user_id, event_type AS f, floor(value * 10)::BIGINT AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        w AS (SELECT *, CASE WHEN c = 0 THEN 0 ELSE floor((c + 3) / 4.0)::BIGINT END AS want FROM e),
        r AS (SELECT user_id, 0::BIGINT AS n, []::VARCHAR[] AS files, 0::BIGINT AS used, '' AS state, 0::BIGINT AS given FROM (SELECT DISTINCT user_id FROM events)
              UNION ALL
              SELECT user_id, n, CASE WHEN NOT list_contains(files, f) AND s <> 'file_budget' THEN list_append(files, f) ELSE files END, used + CASE s WHEN 'ok' THEN want WHEN 'truncated' THEN 2000 - used ELSE 0 END, s, CASE s WHEN 'ok' THEN c WHEN 'truncated' THEN (2000 - used) * 4 ELSE 0 END
              FROM (SELECT w.*, r.files, r.used, CASE WHEN NOT list_contains(files, f) AND len(files) >= 3 THEN 'file_budget' WHEN 2000 - used <= 0 THEN 'token_budget' WHEN want > 2000 - used THEN 'truncated' ELSE 'ok' END AS s FROM r JOIN w ON w.user_id = r.user_id AND w.n = r.n + 1))
        SELECT user_id, state, count(*) AS n, sum(given)::BIGINT AS given FROM r WHERE n > 0 GROUP BY 1, 2""",
    "tool_list_files": "WITH f AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents), h AS (SELECT path, count(*) OVER () AS n FROM f WHERE regexp_full_match(path, 'src1.*/.*/.*5\\.txt')) SELECT path, n AS count, n > 200 AS truncated FROM h ORDER BY path LIMIT 200",
    "tool_search_text": "WITH l AS (SELECT doc_id AS file, unnest(ls) AS text, unnest(range(len(ls)))::INT + 1 AS line FROM (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS ls FROM documents WHERE text <> '')), h AS (SELECT * FROM l WHERE contains(text, 'the than') ORDER BY file, line LIMIT 50) SELECT file, line, text, (SELECT count(*) FROM h) >= 50 AS truncated FROM h",
    "usage_summary": f"WITH {RESPONSES} SELECT user_id % 10 AS \"group\", count(*) AS raw_response_count, sum(k)::BIGINT AS prompt_tokens, sum(k * 2)::BIGINT AS completion_tokens, sum(k * 3)::BIGINT AS total_tokens, sum(CASE WHEN k % 2 = 0 THEN k ELSE 0 END)::BIGINT AS reasoning_tokens, round_even(sum(k / 1000.0::DOUBLE), 12) AS observed_cost_usd FROM base GROUP BY 1",
    "provider_hist": "SELECT CASE WHEN event_type <> 'view' THEN event_type ELSE 'unknown' END AS value, count(*) AS n FROM events GROUP BY 1",
    "finish_hist": f"WITH {RESPONSES} SELECT CASE WHEN k % 3 <> 0 THEN 'stop' ELSE 'unknown' END AS value, count(*) AS n FROM base GROUP BY 1",
    "timing_summary": "SELECT user_id, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS started_at, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS finished_at, round(CASE WHEN user_id % 2 = 0 THEN sum(value) ELSE sum(value * 2) END, 2) AS duration_seconds FROM events GROUP BY 1",
    "run_union_last_wins": "WITH f AS (SELECT user_id AS case_id, min(event_id) FILTER (event_id % 2 = 0) AS a, min(event_id) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1) SELECT 'oracle' AS track, 'm1' AS model, case_id, coalesce(b, a) AS event_id FROM f UNION ALL SELECT 'e2e', 'm1', case_id, coalesce(a, b) FROM f",
    "agent_run_summary": "SELECT user_id % 5 AS track, count(*) AS case_count, round_even(avg((event_id % 2)::DOUBLE) FILTER (event_id % 3 <> 0), 6) AS definition_accuracy, round_even(avg((event_id % 5) / 4.0::DOUBLE) FILTER (event_id % 4 <> 0), 6) AS retrieval_recall, count(*) AS tool_calls, sum(event_id % 3)::BIGINT AS files_read, sum(event_id % 100)::BIGINT AS context_tokens, round_even(sum(event_id % 7)::DOUBLE, 3) AS duration_seconds FROM events GROUP BY 1",
    "retry_attempts": "SELECT [200, 404, 408, 425, 429, 500, 503][(event_id % 7 + 1)::INT] AS code, count(*) FILTER (event_id % 7 >= 2) AS retried, count(*) AS n FROM events GROUP BY 1",
    "overfit_state": "WITH e AS (SELECT user_id, arg_min(round(value, 2), event_id) AS initial, arg_max(round(value, 2), event_id) AS final FROM events GROUP BY 1), d AS (SELECT *, round_even(final - initial, 6) AS delta FROM e) SELECT *, CASE WHEN delta > 0.05 THEN 'possible_overfit' WHEN delta < -0.05 THEN 'no_overfit' ELSE 'stable' END AS state FROM d",
    "sft_format": "WITH c AS (SELECT conv_id, string_agg('<|' || trim(role) || '|>' || chr(10) || trim(text, ' '), chr(10) ORDER BY turn) || chr(10) || '<|end|>' AS s FROM conversations GROUP BY 1) SELECT conv_id, sha256(s) AS sample_sha256, length(s)::INT AS chars FROM c",
    "sft_last_role": "SELECT conv_id, 'last role is not assistant' AS error FROM conversations GROUP BY 1 HAVING arg_max(role, turn) <> 'assistant'",
    "sft_assistant_mask": f"WITH {MASK} SELECT * FROM masked",
    "sft_token_stats": f"WITH {MASK} SELECT conv_id % 4 AS part, count(*) AS count, min(tokens) AS min_tokens, max(tokens) AS max_tokens, round_even(avg(tokens), 3) AS avg_tokens, min(labels) AS min_label_tokens, max(labels) AS max_label_tokens, round_even(avg(labels), 3) AS avg_label_tokens, count(*) FILTER (tokens > 120) AS truncated_count, count(*) FILTER (labels = 0) AS zero_label_count FROM masked GROUP BY 1",
    "split_isolation": "WITH s AS (SELECT source, CASE doc_id % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents) SELECT source, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM s WHERE NOT (source = 'src3' AND split <> 'train') GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "leakage_block": "SELECT doc_id, 'blocked repository' AS error FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 5 <> 0",
    "contamination_hits": f"WITH {REL} SELECT item_id, doc_id FROM rel",
    "dup_fingerprint": "WITH f AS (SELECT text, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, first_key FROM documents JOIN f USING (text) WHERE doc_id <> first_key",
    "label_coverage": "SELECT lang, count(*) AS unlabelled FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1",
    "tag_coverage": "SELECT tag FROM (VALUES ('en'), ('fr'), ('xx'), ('yy')) t(tag) WHERE tag NOT IN (SELECT lang FROM documents UNION SELECT source FROM documents)",
    "evidence_completeness": f"WITH {GOLD_SQL}, l AS (SELECT case_id, bucket, caller || '->' || callee AS ref, line FROM gold) SELECT case_id, count(*) AS missing, min(ref) AS first FROM l WHERE NOT EXISTS (SELECT 1 FROM l s WHERE s.line <> 3 AND s.case_id = l.case_id AND s.bucket = l.bucket AND s.ref = l.ref) GROUP BY 1",
    "edge_label_checks": f"WITH {GOLD_SQL}, o AS (SELECT bucket, line - 1 AS line, CASE WHEN line <> 2 THEN evidence END AS evidence, pos FROM gold) SELECT error, count(*) AS n FROM (SELECT 'evidence missing' AS error FROM o WHERE bucket <> 'excluded' AND evidence IS NULL UNION ALL SELECT 'line not positive' FROM o WHERE bucket <> 'excluded' AND line <= 0 UNION ALL SELECT 'reason missing' FROM o WHERE bucket = 'excluded' AND pos % 2 <> 0 UNION ALL SELECT 'place incomplete' FROM o WHERE bucket = 'excluded' AND evidence IS NULL) GROUP BY 1",
    "metadata_checks": "SELECT printf('ft-synth-%04d', i) AS id, 'no evidence' AS error FROM range(1, 501) t(i) WHERE i % 10 = 7",
    "bucketed_quality": "SELECT lang, source, count(*) AS n, round_even(avg(quality), 6) AS quality, round_even(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source))",
    "evidence_at_line": "WITH l AS (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS ls FROM documents WHERE text <> ''), a AS (SELECT item_id AS doc_id, (item_id % 5 + 1)::INT AS line, trim(substr(text, 1, 5)) AS e FROM benchmark) SELECT a.doc_id, a.line, CASE WHEN l.doc_id IS NULL THEN 'file_missing' WHEN a.line > len(ls) THEN 'line_missing' WHEN contains(ls[a.line], e) THEN 'ok' ELSE 'evidence_mismatch' END AS state FROM a LEFT JOIN l USING (doc_id)",
    "sample_generator_counts": "WITH s AS (SELECT i, (i - 1) % 29 AS p FROM range(1, 501) t(i)) SELECT count(*) AS samples, count(*) FILTER (i % 5 <> 0) AS train, count(*) FILTER (i % 5 = 0) AS dev, count(*) FILTER (p NOT IN (2, 3, 4, 5, 8, 12, 13, 14, 15, 16, 17, 22, 28)) AS positive, count(*) FILTER (p IN (2, 3, 8, 12, 13, 16, 17, 28)) AS negative, count(*) FILTER (p IN (4, 5, 14, 15, 22)) AS boundary, count(*) FILTER (p IN (24, 25, 27)) AS multi_edge_outputs, count(*) FILTER (p = 25) AS depth_2_call_chains, count(DISTINCT ((i % 5 = 0)::INT, (i - 1) // 5)) AS repos FROM s",
    "sample_retag": "SELECT i, printf('ft-full-synth-%03d', i) AS id, CASE WHEN i % 5 = 0 THEN 'dev' ELSE 'train' END AS split, 'synthetic/' || CASE WHEN i % 5 = 0 THEN 'dev' ELSE 'train' END || '-micro-' || lpad(((i - 1) // 5)::VARCHAR, 2, '0') AS repo, true AS answer_has_id FROM range(1, 61) t(i)",
    "plan_matrix": "WITH c AS (SELECT DISTINCT ['S', 'P', 'S+P', 'base'][(p_partkey % 4 + 1)::INT] AS combination FROM part) SELECT r_name AS model, combination, track, CASE WHEN combination LIKE 'S%' AND NOT (combination = 'S' AND track = 'oracle') THEN 'requires_prompt_assembly' WHEN combination LIKE '%P%' THEN 'ready_with_postprocess_plan' ELSE 'ready' END AS status FROM region, c, (VALUES ('oracle'), ('e2e')) t(track)",
    "redact_keys": "SELECT event_id, '<redacted>' AS a, event_type AS b, json_extract_string(props, '$.k') AS c, CASE WHEN event_id % 2 = 0 THEN '' END AS d FROM events",
    "tumbling_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "session_windows": "WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o), c AS (SELECT user_id, g, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1",
}

_RAW = """
raw AS (SELECT case_id, caller, CASE WHEN ends_with(callee, '.__init__') AND contains(evidence, ' ' || replace(callee, '.__init__', '') || '(') THEN replace(callee, '.__init__', '') ELSE callee END AS callee, 'src/f' || (CAST(substr(caller, 2) AS BIGINT) % 10) || '.py' AS file, line, evidence, pos, CASE WHEN pos % 3 = 0 THEN 0 ELSE 2 END AS q, line = 7 AS tested FROM pred)"""

ORACLES |= {
    "edge_compare": f"WITH {GOLD_SQL}, {PLAIN} {CASE_SCORES}, a AS (SELECT * FROM scores), {CTOR.replace(SCORE, '').replace('keyed AS', 'keyed2 AS')} {CASE_SCORES.replace('hit AS', 'hit2 AS').replace('FROM keyed k', 'FROM keyed2 k').replace('sums AS', 'sums2 AS').replace('FROM hit GROUP', 'FROM hit2 GROUP').replace('req AS', 'req2 AS').replace('scores AS', 'scores2 AS').replace('JOIN req USING', 'JOIN req2 USING').replace('JOIN sums USING', 'JOIN sums2 USING')} SELECT case_id, a.edge_precision AS edge_precision_before, b.edge_precision AS edge_precision_after, a.edge_recall AS edge_recall_before, b.edge_recall AS edge_recall_after, round_even(b.edge_precision - a.edge_precision, 6) AS edge_precision_delta, round_even(b.edge_recall - a.edge_recall, 6) AS edge_recall_delta FROM a JOIN scores2 b USING (case_id)",
    "postprocess_stats": f"WITH {GOLD_SQL}, {_RAW}, o AS (SELECT *, CASE WHEN NOT tested THEN row_number() OVER (PARTITION BY case_id, caller, callee, file, line, evidence, tested ORDER BY pos) END AS nth FROM raw), u AS (SELECT *, nth = 1 AS uniq FROM o), c AS (SELECT *, coalesce(uniq, false) AND row_number() OVER (PARTITION BY case_id, caller, callee ORDER BY CASE WHEN coalesce(uniq, false) THEN 0 ELSE 1 END, q, file, line, evidence, pos) = 1 AS chosen FROM u) SELECT case_id, count(*) AS input_edges, 0::BIGINT AS malformed_edges_removed, count(*) FILTER (tested) AS filtered_edges_removed, count(*) FILTER (nth > 1) AS exact_duplicates_removed, count(*) FILTER (coalesce(uniq, false) AND NOT chosen) AS symbol_duplicates_removed, count(*) FILTER (chosen) AS output_edges FROM c GROUP BY 1",
    "candidate_merge": """WITH r AS (SELECT l_orderkey % 50 AS case_id, 's' || (l_suppkey % 20) AS caller, 'p' || (l_partkey % 20) AS callee, CASE WHEN l_linenumber = 1 THEN 'primary' ELSE 'secondary' END AS status, l_shipdate::VARCHAR AS expression, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS pos FROM lineitem WHERE l_linenumber <> 7),
        g AS (SELECT case_id, caller, callee, first(struct_pack(s := status, e := expression, l := line) ORDER BY status, pos) AS b, min(status) AS status, min(pos) AS fp, count(*) AS evidence_count, count(DISTINCT struct_pack(s := status, e := expression, l := line)) - 1 AS others FROM r GROUP BY ALL)
        SELECT case_id, printf('edge-%03d', row_number() OVER (PARTITION BY case_id ORDER BY status, fp, caller, callee)) AS candidate_id, caller, callee, status, evidence_count, least(others, 5) AS more FROM g""",
    "link_reason_filter": f"WITH {LINKS} SELECT 'kept' AS reason, count(*) AS n FROM links",
    "py_definitions": "SELECT * FROM (VALUES ('pkg.box', 'pkg.box.Box', 'class', 5, 14), ('pkg.box', 'pkg.box.Box.open', 'function', 6, 9), ('pkg.box', 'pkg.box.Box.close', 'function', 11, 14), ('pkg.box', 'pkg.box.Box.close.inner', 'function', 12, 13)) t(module, symbol, kind, start, \"end\")",
    "py_calls": "SELECT * FROM (VALUES ('pkg.box', 7, 'h', 'a.b.helper'), ('pkg.box', 8, 'self.close', 'pkg.box.Box.close'), ('pkg.box', 9, 'os.path.join', 'os.path.join')) t(module, line, name, resolved)",
    "yaml_payloads": "SELECT case_id, pos, caller, callee, file::VARCHAR AS file, line::VARCHAR AS line, evidence, confidence_type::VARCHAR AS confidence_type, notes::VARCHAR AS notes FROM (VALUES ('c1', 0, 'a.b', 'c.d', NULL, NULL, 'x: y', NULL, NULL), ('c2', 0, 'e', 'f', NULL, NULL, NULL, NULL, NULL)) t(case_id, pos, caller, callee, file, line, evidence, confidence_type, notes)",
    "callee_resolution": "WITH e AS (SELECT p_partkey, ['self.run', 'h', 'h.x', 'obj.go', 'logger.info', 'cls', 'a.b.c', 'q'][(p_partkey % 8 + 1)::INT] AS expression FROM part), h AS (SELECT *, CASE expression WHEN 'q' THEN 'pkg.mod.q' WHEN 'self.run' THEN 'pkg.mod.Box.run' WHEN 'h' THEN 'pkg.helpers.h' WHEN 'h.x' THEN 'pkg.helpers.h.x' WHEN 'obj.go' THEN 'pkg.mod.Obj.go' WHEN 'logger.info' THEN 'logger.info' WHEN 'cls' THEN 'pkg.mod.Box' WHEN 'a.b.c' THEN 'a.b.c' END AS hint FROM e) SELECT *, CASE WHEN expression = 'logger.info' THEN 'filtered_low_value' WHEN starts_with(hint, 'pkg.') THEN 'primary' ELSE 'secondary' END AS status FROM h",
}

ORACLES |= {
    "call_lines": """WITH l AS (SELECT *, l_partkey % 6 AS m, l_partkey::VARCHAR AS k FROM lineitem)
        SELECT l_orderkey, l_linenumber, m = 1 AS definition, CASE m WHEN 3 THEN 'h' || k || '.run' ELSE '' END AS callbacks,
            CASE m WHEN 0 THEN '    x = p' || k || '.go(len(y))  ' WHEN 1 THEN chr(9) || 'def f' || k || '(a):' WHEN 2 THEN 's = ''#'' + f' || k || '(''#'') ' WHEN 3 THEN 'signals.connect(h' || k || '.run, sender)' WHEN 4 THEN '' ELSE 'if (a' || k || '(b.c(1)) and not isinstance(d, e)):' END AS code,
            CASE m WHEN 0 THEN 'p' || k || '.go' WHEN 1 THEN 'f' || k WHEN 2 THEN 'f' || k WHEN 3 THEN 'signals.connect' WHEN 4 THEN '' ELSE 'a' || k || ',b.c' END AS calls FROM l""",
    "local_alias_map": """WITH s AS (SELECT (p_partkey // 2) % 5 AS lib, 't' || (p_partkey // 2) AS tail, 'pkg.m' || (p_partkey % 4) AS module, p_partkey FROM part WHERE p_partkey % 6 <> 5)
        SELECT lib, tail, min(module || '.' || tail) AS symbol FROM s WHERE lib < 4 OR module = 'pkg.m1' GROUP BY 1, 2 HAVING count(DISTINCT module) = 1""",
    "receiver_types": """WITH t AS (SELECT l_orderkey, l_linenumber, 'n' || (l_suppkey % 3) AS name, CASE l_partkey % 4 WHEN 0 THEN 'm.Local' WHEN 1 THEN 'app.http.Req' WHEN 2 THEN 'lib.X' END AS type FROM lineitem)
        SELECT l_orderkey, name, min(struct_pack(l := l_linenumber, t := type)).t AS type FROM t WHERE type IS NOT NULL GROUP BY 1, 2
        UNION ALL SELECT DISTINCT l_orderkey, name, 'm.Owner' FROM lineitem, (VALUES ('self'), ('cls')) n(name) WHERE l_orderkey % 2 = 0""",
    "agent_reads": """WITH p AS (SELECT l_orderkey AS case_id, 'f' || (l_partkey % 20) AS file, l_linenumber, l_suppkey FROM lineitem), r AS (SELECT DISTINCT case_id, file, true AS seen FROM p WHERE l_suppkey % 2 = 0),
        d AS (SELECT case_id, min(CASE WHEN seen THEN 1.0 ELSE 0.0 END)::DOUBLE AS d FROM p LEFT JOIN r USING (case_id, file) WHERE l_linenumber = 2 GROUP BY 1), e AS (SELECT case_id, round_even(count(seen) / count(*), 6) AS e FROM p LEFT JOIN r USING (case_id, file) GROUP BY 1)
        SELECT o_orderkey AS case_id, coalesce(d, 0.0)::DOUBLE AS definition_accuracy, e AS retrieval_recall FROM orders LEFT JOIN d ON d.case_id = o_orderkey LEFT JOIN e ON e.case_id = o_orderkey""",
    "query_dedupe": "SELECT user_id AS case_id, min(event_id) AS ord, event_type AS text FROM events GROUP BY 1, 3",
    "mirror_checks": "SELECT doc_id, 'quality and toxic differ' AS error FROM labels WHERE quality IS DISTINCT FROM toxic",
}

_SPANNED = """c AS (SELECT p_partkey AS chunk_id, p_partkey // 10 AS file, p_partkey % 10 * 10 + 1 AS start_line, p_partkey % 10 * 10 + 14 AS end_line FROM part),
    d AS (SELECT l_partkey // 10 AS file, 's' || l_suppkey AS symbol, l_orderkey % 120 AS b, l_orderkey % 120 + l_linenumber * 3 AS e FROM lineitem),
    o AS (SELECT c.*, symbol, b FROM c JOIN d ON c.file = d.file AND b <= end_line AND e >= start_line)"""

ORACLES |= {
    "chunk_definitions": f"""WITH {_SPANNED}, g AS (SELECT chunk_id, symbol, min(b) AS b, count(*) AS n FROM o GROUP BY 1, 2), l AS (SELECT chunk_id, sum(n) AS n, string_agg(symbol, ',' ORDER BY b, symbol) AS defined FROM g GROUP BY 1)
        SELECT chunk_id, coalesce(n, 0)::BIGINT AS n_spans, coalesce(defined, '') AS defined FROM c LEFT JOIN l USING (chunk_id)""",
    "definition_pick": f"""WITH {_SPANNED}, r AS (SELECT s_suppkey AS case_id, chunk_id, chunk_id % 4 AS score, row_number() OVER (PARTITION BY s_suppkey ORDER BY CASE WHEN b BETWEEN start_line AND end_line THEN 0 ELSE 1 END, chunk_id % 4 DESC, start_line, chunk_id) AS nth FROM supplier JOIN o ON symbol = 's' || s_suppkey)
        SELECT case_id, chunk_id, CASE WHEN score = 0 THEN 1 ELSE score END::DOUBLE AS score FROM r WHERE nth = 1""",
    "definition_queries": "SELECT p_partkey AS case_id, 'target_definition_slot' AS label, 'pkg.m.t' || p_partkey AS text, 'pkg.m.t' || p_partkey AS symbols, CASE WHEN p_partkey % 3 = 0 THEN 'class t' || p_partkey ELSE 'def t' || p_partkey || '(,async def t' || p_partkey || '(' END AS patterns FROM part",
    "options_of_cases": "SELECT l_orderkey AS case_id, l_linenumber, l_orderkey % 3 <> 0 AND l_orderkey % 4 = 0 AS opt_tests, 'summarise' AS opt_deps, CASE WHEN l_orderkey % 3 <> 0 AND l_orderkey % 7 = 0 THEN 'workspace' ELSE 'repo_only' END AS opt_scope FROM lineitem",
    "rendered_candidates": """WITH h AS (SELECT l_suppkey AS case_id, CASE WHEN l_linenumber % 3 = 0 THEN 'primary' ELSE 'secondary' END AS status, CASE WHEN l_partkey % 5 <> 0 THEN l_partkey END AS rank, 'f' || l_orderkey AS file, l_linenumber AS line, 'e' || l_partkey AS expression FROM lineitem WHERE l_linenumber % 3 <> 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY status, coalesce(rank, 999999), file, line, expression) AS nth FROM h) WHERE nth <= 60""",
}
