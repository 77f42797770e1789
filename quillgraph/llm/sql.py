"""DuckDB SQL for the operators that SQL can express; each reads the whole tables."""

ORACLES: dict[str, str] = {}

ORACLES["op7_mix_sources"] = r"""
WITH sized AS (
    SELECT doc_id, source, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
    SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap FROM sizes),
summed AS (
    SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
           (sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source COLLATE "C" NULLS LAST ROWS UNBOUNDED PRECEDING))::BIGINT - cap AS prior,
           (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source COLLATE "C" NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS remaining
    FROM ranked),
clamped AS (SELECT *, cap * remaining <= (total - prior) * weight AS is_full FROM summed),
leveled AS (
    SELECT *, (sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::BIGINT AS spent,
           (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::BIGINT AS opened FROM clamped),
targets AS (
    SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (total - spent)::DOUBLE * weight / opened END AS target FROM leveled),
wanted AS (
    SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM targets),
run AS (
    SELECT s.doc_id, s.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS extra,
           (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size ROWS UNBOUNDED PRECEDING))::BIGINT AS reached
    FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN extra > 0 AND reached - extra <= extra - (reached - size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""

ORACLES["op4_decontaminate"] = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents),
item AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL),
win AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
    FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
spot AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
    FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, lens WHERE len(w) >= n)),
hit AS (SELECT s.r, s.n, s.i, v.item_id FROM spot s JOIN win v ON s.n = v.n AND s.gram = v.gram),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


def _license_sql() -> str:
    """The rules one after another, each a step on the texts' identifier sequences."""
    import re

    from quillgraph.llm.licenses import MARKERS, RULES, SENTENCES, rule_pattern

    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps, last = [], "s0"
    for k, (name, ids) in enumerate(RULES, 1):
        pattern, keep = rule_pattern(ids)
        keep = re.sub(r"\$(\d)", r"\\\1", keep)
        steps.append(f"s{k} AS (SELECT r, doc_id, ids, CASE WHEN regexp_matches(s, '{pattern}') THEN regexp_replace(s, '{pattern}', '{keep}', 'g') ELSE s END AS s, CASE WHEN regexp_matches(s, '{pattern}') AND NOT list_contains(f, '{name}') THEN list_append(f, '{name}') ELSE f END AS f FROM {last})")
        last = f"s{k}"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
marked AS (SELECT r, string_split_regex(regexp_replace(regexp_replace(text, '(?i)(SPDX-License-Identifier):', '\1', 'g'), '([.!?;:])[ \t-\r]+', '\1' || chr(10), 'g'), '[\n\r]+') AS cut FROM doc WHERE regexp_matches(text, '(?i){MARKERS}')),
each AS (SELECT r, unnest(cut) AS raw, unnest(range(len(cut))) AS p FROM marked),
hit AS (SELECT r, p, id FROM (SELECT r, p, regexp_replace(lower(trim(regexp_replace(raw, '[^A-Za-z0-9.+-]+', ' ', 'g'))), '[ .]+$', '') AS sentence FROM each) JOIN known USING (sentence)),
seq AS (SELECT r, string_agg(id, ',' ORDER BY p) AS ids FROM hit GROUP BY r),
s0 AS (SELECT d.r, d.doc_id, coalesce(ids, '') AS ids, coalesce(ids || ',', '') AS s, []::VARCHAR[] AS f FROM doc d LEFT JOIN seq USING (r)),
{", ".join(steps)}
SELECT doc_id, ids AS sentence_ids, array_to_string(list_sort(f), ',') AS licenses, len(f)::BIGINT AS n_licenses FROM {last}
"""


ORACLES["op6_license_scan"] = _license_sql()


def _posterior_sql(name: str, groups: str, key: str) -> str:
    """Prior strength by moments over ``groups`` (key, n, y, up), and each group's posterior a and b."""
    return f"""
{name}_rho AS (SELECT coalesce(sum((y - n * up) * (y - n * up) - n * up * (1 - up)) / nullif(sum(n * (n - 1) * up * (1 - up)), 0), 0.0) AS rho FROM {groups} WHERE n > 1),
{name}_strength AS (SELECT greatest(1.0, least(200.0, CASE WHEN rho <= 0 THEN 200.0 WHEN rho >= 1 THEN 1.0 ELSE (1 - rho) / rho END)) AS s FROM {name}_rho),
{name} AS (SELECT {key}, s * up + y AS a, s * (1 - up) + n - y AS b FROM {groups}, {name}_strength)"""


ORACLES["op5_url_filter"] = rf"""
WITH p AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
lab AS (SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels GROUP BY 1),
seen AS (SELECT host, bad FROM p JOIN lab ON doc_id = TRY_CAST(nullif(regexp_extract(path, '^/[^/]*/(\d{{1,18}})', 1), '') AS BIGINT) WHERE bad IS NOT NULL),
cnt AS (SELECT host, count(*) AS n, sum(bad) AS y FROM seen GROUP BY 1),
bare AS (SELECT DISTINCT host, regexp_replace(host, ':\d*$', '') AS h FROM p),
base AS (
    SELECT host, coalesce(n, 0)::DOUBLE AS n, coalesce(y, 0)::DOUBLE AS y, regexp_extract(h, '([^.]*\.(?:(?:co|com|net|org|gov|edu|ac)\.[a-z]{{2}}|[^.]*)|[^.]*)$', 1) AS domain,
           coalesce(nullif(ltrim(regexp_extract(h, '((?:^|\.)(?:co|com|net|org|gov|edu|ac)\.[a-z]{{2}})$', 1), '.'), ''), regexp_extract(h, '([^.]*)$', 1)) AS suffix
    FROM bare LEFT JOIN cnt USING (host)),
dom AS (SELECT domain, sum(n) AS n, sum(y) AS y, max(suffix) AS suffix FROM base GROUP BY 1),
suf AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM dom GROUP BY 1),
suf_up AS (SELECT suf.*, (SELECT (sum(y) + 1) / (sum(n) + 2) FROM suf) AS up FROM suf),
{_posterior_sql("ps", "suf_up", "suffix")},
dom_up AS (SELECT dom.*, a / (a + b) AS up FROM dom JOIN ps USING (suffix)),
{_posterior_sql("pd", "dom_up", "domain")},
host_up AS (SELECT base.*, a / (a + b) AS up FROM base JOIN pd USING (domain)),
{_posterior_sql("ph", "host_up", "host")},
own AS (SELECT host, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.25 THEN 'block' ELSE 'allow' END AS own FROM ph),
ruled AS (
    SELECT page_id, host, path, own, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
    FROM p JOIN own USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE own END AS verdict FROM ruled
"""

#: All pairs, exactly; the operators' searches are held against it.
_REACH = """
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT id AS n, id AS c FROM node UNION SELECT r.n, e.b FROM reach r JOIN edge e ON e.a = r.c),
root AS (SELECT n AS id, min(c) AS component_id FROM reach GROUP BY 1)"""

ORACLES["op1_near_duplicates"] = rf"""
WITH RECURSIVE doc AS (
    SELECT doc_id AS id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
placed AS (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM doc WHERE len(w) > 0),
sh AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM placed),
node AS (SELECT d.id, count(g) AS n FROM (SELECT DISTINCT id FROM doc) d LEFT JOIN sh USING (id) GROUP BY 1),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM sh x JOIN sh y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN node p ON p.id = a JOIN node q ON q.id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
{_REACH}
SELECT d.doc_id, n AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN node ON node.id = d.doc_id JOIN root ON root.id = d.doc_id
"""

ORACLES["op10_embedding_duplicates"] = f"""
WITH RECURSIVE node AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
fine AS (SELECT * FROM node WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
link AS (SELECT p.id AS a, q.id AS b FROM fine p JOIN fine q ON p.id < q.id AND len(p.v) = len(q.v) WHERE list_inner_product(p.v, q.v) / (sqrt(list_inner_product(p.v, p.v)) * sqrt(list_inner_product(q.v, q.v))) >= 0.95),
{_REACH},
counts AS (SELECT a AS id, count(*) AS n_links FROM edge GROUP BY 1)
SELECT id AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM node JOIN root USING (id) LEFT JOIN counts USING (id)
"""
