"""DuckDB statements of the queries, over the same adapters."""

from __future__ import annotations

from loomgraph.plans.fixtures import MENTIONS, PER_DOC, RAW_CLAIMS, SQL, TOK_DUCKDB
from loomgraph.schema import EDGE_COLOURS, NODE_COLOURS

MAIL = f"""mail_raw AS ({SQL["mail_raw"]}),
mail AS (SELECT *, left(message, strpos(message, chr(10) || chr(10)) - 1) AS head, substr(message, strpos(message, chr(10) || chr(10)) + 2) AS body FROM mail_raw),
art AS (SELECT file AS file_path, split_part(file, '/', 1) AS mailbox, regexp_extract(head, 'Message-ID: ([^\\n]*)', 1) AS message_id, lower(regexp_extract(head, '\\nFrom: ([^\\n]*)', 1)) AS sender,
               regexp_extract(head, '\\nX-From: ([^\\n]*)', 1) AS sender_name, regexp_extract(head, '\\nTo: ([^\\n]*)', 1) AS to_raw, regexp_extract(head, '\\nSubject: ([^\\n]*)', 1) AS subject, regexp_extract(head, '\\nCc: ([^\\n]*)', 1) AS cc_raw, regexp_extract(head, '\\nX-Origin: ([^\\n]*)', 1) AS x_origin,
               strptime(regexp_extract(head, '\\nDate: [A-Za-z]+, ([^(\\n]*[0-9])', 1), '%d %b %Y %H:%M:%S %z') AT TIME ZONE 'UTC' AS date, body,
               CASE WHEN body = '' THEN '' ELSE sha256(body) END AS body_hash FROM mail)"""
FORWARD = "(body <> '' AND (contains(lower(subject), 'fw:') OR contains(lower(subject), 'fwd:') OR contains(left(lower(body), 500), '--- forwarded')))"
REPLY = "starts_with(lower(subject), 're:')"
TO = "array_to_string(list_transform(string_split(to_raw, ','), lambda x: lower(trim(x))), '|')"
CC = "list_transform(list_filter(string_split(cc_raw, ','), lambda x: trim(x) <> ''), lambda x: lower(trim(x)))"
KG = ", ".join(f"{k} AS ({SQL[k]})" for k in ("kg_nodes", "kg_aliases", "kg_edges"))
ENDS = "ends AS (SELECT src AS id FROM kg_edges UNION ALL SELECT dst FROM kg_edges WHERE dst <> src)"
DEG = "deg AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)"
NORM = "regexp_replace(regexp_replace(lower(trim({0})), '^[\"'']+|[\"'']+$', '', 'g'), '\\s+', ' ', 'g')"

# Entity resolution, pass by pass.
TOK = f"tok AS ({TOK_DUCKDB}), mentions AS (SELECT *, artifact_id * {PER_DOC} + idx AS ord FROM ({MENTIONS})), m AS (SELECT *, {NORM.format('name')} AS norm FROM mentions WHERE length({NORM.format('name')}) >= 2)"
EXACT = f"""{TOK},
sp AS (SELECT norm, name, count(*) AS c, min(ord) AS o FROM m GROUP BY norm, name),
ca AS (SELECT norm, name AS canonical_name FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY c DESC, length(name) DESC, o) AS r FROM sp) WHERE r = 1),
ty AS (SELECT norm, entity_type FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY c DESC, o) AS r FROM (SELECT norm, entity_type, count(*) AS c, min(ord) AS o FROM m GROUP BY norm, entity_type)) WHERE r = 1),
g0 AS (SELECT norm, min(ord) AS gid, count(*) AS mention_count FROM m GROUP BY norm),
g1 AS (SELECT gid, norm, canonical_name, entity_type, mention_count FROM g0 JOIN ca USING (norm) JOIN ty USING (norm)),
al1 AS (SELECT DISTINCT gid, a FROM (SELECT norm, name AS a FROM m UNION SELECT norm, trim(alias) FROM m WHERE alias IS NOT NULL AND trim(alias) <> '') x JOIN g1 USING (norm) WHERE a <> canonical_name),
so1 AS (SELECT DISTINCT gid, artifact_id FROM m JOIN g1 USING (norm)),
nm1 AS (SELECT norm, arg_min(gid, rank * 1000000000000 + gid) AS gid FROM (SELECT norm, gid, 0 AS rank FROM g1 UNION ALL SELECT {NORM.format('a')}, gid, 1 FROM al1) WHERE norm <> '' GROUP BY norm)"""
GROUPS = "SELECT gid, canonical_name, entity_type, mention_count, (SELECT coalesce(string_agg(a, '|' ORDER BY a), '') FROM {al} x WHERE x.gid = g.gid) AS aliases, (SELECT count(*) FROM {so} x WHERE x.gid = g.gid) AS n_sources FROM {g} g"


def _merge(k: int, j: int, edges: str, best: str) -> str:
    """Groups of pass ``j`` from those of pass ``k`` and the edge table ``edges``."""
    return f"""
u{j} AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
w{j}(gid, root) AS (SELECT gid, gid FROM g{k} UNION SELECT u{j}.b, w{j}.root FROM w{j} JOIN u{j} ON u{j}.a = w{j}.gid),
r{j} AS (SELECT gid, min(root) AS root FROM w{j} GROUP BY gid),
b{j} AS (SELECT root, canonical_name, entity_type FROM (SELECT r.root, g.*, row_number() OVER (PARTITION BY r.root ORDER BY {best}) AS k FROM g{k} g JOIN r{j} r USING (gid)) WHERE k = 1),
g{j} AS (SELECT root AS gid, b.canonical_name, b.entity_type, sum(g.mention_count)::BIGINT AS mention_count FROM g{k} g JOIN r{j} r USING (gid) JOIN b{j} b USING (root) GROUP BY root, b.canonical_name, b.entity_type),
n{j} AS (SELECT DISTINCT root AS gid, a FROM (SELECT gid, a FROM al{k} UNION SELECT gid, canonical_name FROM g{k}) x JOIN r{j} USING (gid)),
al{j} AS (SELECT n.gid, a FROM n{j} n JOIN g{j} g USING (gid) WHERE a <> canonical_name),
so{j} AS (SELECT DISTINCT root AS gid, artifact_id FROM so{k} JOIN r{j} USING (gid)),
nm{j} AS (SELECT norm, gid FROM nm{k} WHERE NOT EXISTS (SELECT 1 FROM {edges}) UNION ALL SELECT norm, gid FROM (SELECT {NORM.format('a')} AS norm, max(gid) AS gid FROM n{j} GROUP BY 1) WHERE EXISTS (SELECT 1 FROM {edges}))"""


ALIAS = f"""{EXACT},
e2 AS (SELECT DISTINCT h.gid AS a, o.gid AS b FROM (SELECT gid, entity_type, {NORM.format('a')} AS norm FROM al1 JOIN g1 USING (gid)) h JOIN nm1 o ON o.norm = h.norm JOIN g1 t ON t.gid = o.gid AND t.entity_type = h.entity_type WHERE h.gid <> o.gid),{_merge(1, 2, 'e2', 'mention_count DESC, gid')}"""
#: Similarity by the same bit-parallel recurrence, as a recursive table over the characters of the second name.
PAIRS = f"""
q AS (SELECT gid, entity_type, n, left(n, 3) AS block FROM (SELECT gid, entity_type, {NORM.format('canonical_name')} AS n FROM g2) WHERE length(n) >= 4 AND NOT (contains(n, '@') AND contains(n, '.')) AND NOT regexp_full_match(n, '[0-9]+')),
cand AS (SELECT a.gid AS a, b.gid AS b, a.n AS x, b.n AS y FROM q a JOIN q b ON a.entity_type = b.entity_type AND a.block = b.block AND a.gid < b.gid WHERE 10 * abs(length(a.n) - length(b.n)) <= length(a.n) + length(b.n) AND levenshtein(a.n, b.n) <= (length(a.n) + length(b.n)) // 10),
lcs(a, b, x, y, i, s) AS (
  SELECT a, b, x, y, 0, CAST(pow(2, length(x)) AS HUGEINT) - 1 FROM cand
  UNION ALL
  SELECT a, b, x, y, i + 1, ((s + u) | (s - u)) & (CAST(pow(2, length(x)) AS HUGEINT) - 1)
  FROM (SELECT a, b, x, y, i, s, s & CAST(list_sum(list_transform(range(length(x)), lambda k: CASE WHEN substr(x, k + 1, 1) = substr(y, i + 1, 1) THEN CAST(pow(2, k) AS HUGEINT) ELSE 0::HUGEINT END)) AS HUGEINT) AS u FROM lcs WHERE i < length(y))),
sim AS (SELECT a, b FROM lcs WHERE i = length(y) AND 10 * (length(x) + length(y) - 2 * (length(x) - bit_count(s))) <= length(x) + length(y))"""
PREFIX = f"""
s0 AS (SELECT gid, entity_type, {NORM.format('canonical_name')} AS n FROM g2),
s1 AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY n, gid) AS r FROM s0),
pre AS (SELECT DISTINCT least(p.gid, q.gid) AS a, greatest(p.gid, q.gid) AS b FROM s1 p JOIN s1 q ON p.entity_type = q.entity_type AND q.r BETWEEN p.r + 1 AND p.r + 4
        WHERE length(p.n) >= 5 AND length(q.n) >= 5 AND (starts_with(CASE WHEN length(p.n) <= length(q.n) THEN q.n ELSE p.n END, CASE WHEN length(p.n) <= length(q.n) THEN p.n ELSE q.n END || ' ')
           OR starts_with(CASE WHEN length(p.n) <= length(q.n) THEN q.n ELSE p.n END, CASE WHEN length(p.n) <= length(q.n) THEN p.n ELSE q.n END || '.')))"""
FUZZY = f"""{ALIAS},{PAIRS},{PREFIX},
e3 AS (SELECT a, b FROM sim UNION SELECT a, b FROM pre),{_merge(2, 3, 'e3', 'mention_count DESC, length(canonical_name) DESC, gid')}"""
CLAIMS = f"""{FUZZY},
raw AS (SELECT *, artifact_id * {PER_DOC} + idx AS ord FROM ({RAW_CLAIMS})),
placed AS (SELECT raw.*, s.gid AS s, coalesce(o.gid, s.gid) AS o, s.gid IS NULL OR (o.gid IS NULL AND {NORM.format('object')} <> '') AS skipped
           FROM raw LEFT JOIN nm3 s ON s.norm = {NORM.format('subject')} LEFT JOIN nm3 o ON o.norm = {NORM.format('object')}),
cl AS (SELECT claim_type, s, o, CAST(arg_min(idx, ord) AS VARCHAR) AS detail, max(confidence) AS confidence, count(*) AS mention_count, md5(string_agg(excerpt, '|' ORDER BY ord)) AS evidence_md5 FROM placed WHERE NOT skipped GROUP BY claim_type, s, o)"""

REACH2 = """pairs2 AS (SELECT src AS a, dst AS b FROM kg_edges WHERE src <> dst UNION SELECT dst, src FROM kg_edges WHERE src <> dst),
c AS (SELECT id FROM kg_nodes n WHERE {pick}),
d1 AS (SELECT DISTINCT b AS id FROM pairs2 JOIN c ON a = c.id),
d2 AS (SELECT DISTINCT b AS id FROM pairs2 JOIN d1 ON a = d1.id),
circle AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM kg_edges, c WHERE src = c.id AND dst = c.id) THEN 1
                       WHEN EXISTS (SELECT 1 FROM (SELECT CASE WHEN src = c.id THEN dst ELSE src END AS n FROM kg_edges, c WHERE src <> dst AND (src = c.id OR dst = c.id)) GROUP BY n HAVING count(*) > 1) THEN 2 END AS k),
near AS (SELECT id, min(dist) AS dist FROM (SELECT id, 1 AS dist FROM d1 UNION ALL SELECT id, 2 FROM d2 WHERE {depth} >= 2) WHERE id NOT IN (SELECT id FROM c) GROUP BY id
         UNION ALL SELECT c.id, k FROM c, circle WHERE k <= {depth}),
top AS (SELECT near.id, dist FROM near JOIN kg_nodes n ON n.id = near.id ORDER BY dist, mention_count DESC NULLS FIRST, near.id LIMIT {cap}),
ids AS (SELECT id, min(dist) AS dist FROM (SELECT id, dist FROM top UNION ALL SELECT id, 0 FROM c) GROUP BY id)"""


#: The shortest path from its end, at every step by the smallest id one level nearer to the source.
PATH = f"""WITH RECURSIVE {KG}, pairs2 AS (SELECT src AS a, dst AS b FROM kg_edges WHERE src <> dst UNION SELECT dst, src FROM kg_edges WHERE src <> dst),
w(id, hops) AS (SELECT 'customer:1', 0 UNION SELECT pairs2.b, w.hops + 1 FROM w JOIN pairs2 ON pairs2.a = w.id WHERE w.hops < 4),
lv AS (SELECT id, min(hops) AS hops FROM w GROUP BY id),
back AS (SELECT l.id, l.hops, min(m.id) AS near FROM lv l JOIN pairs2 ON pairs2.a = l.id JOIN lv m ON m.id = pairs2.b AND m.hops = l.hops - 1 GROUP BY l.id, l.hops),
walk(id, hops) AS (SELECT id, hops FROM lv WHERE id = 'region:4' UNION ALL SELECT back.near, walk.hops - 1 FROM walk JOIN back ON back.id = walk.id),
hop AS (SELECT id, hops AS step FROM walk),
rel AS (SELECT step, r.rel_type, r.src, r.dst FROM (SELECT h.step, min(struct_pack(rel_type := e.rel_type, src := e.src, dst := e.dst)) AS r FROM hop h JOIN hop g ON g.step = h.step - 1 JOIN kg_edges e ON least(e.src, e.dst) = least(h.id, g.id) AND greatest(e.src, e.dst) = greatest(h.id, g.id) GROUP BY h.step))"""


def _case(column: str, known: dict[str, str], other: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in known.items()) + f" ELSE '{other}' END"


CENTRE = "n.canonical_name = (SELECT n_name FROM nation WHERE n_nationkey = 7)"
REL = """rel AS (SELECT src AS id, 'outgoing' AS direction, dst AS other_id, rel_type, confidence, mention_count FROM kg_edges UNION ALL SELECT dst, 'incoming', src, rel_type, confidence, mention_count FROM kg_edges)"""
LENGTH_CASE = "CASE WHEN length(text) >= 50000 THEN 6 WHEN length(text) >= 10000 THEN 5 WHEN length(text) >= 5000 THEN 4 WHEN length(text) >= 1000 THEN 3 WHEN length(text) >= 500 THEN 2 WHEN length(text) >= 100 THEN 1 ELSE 0 END"
HASH = "CASE WHEN text = '' THEN '' ELSE sha256(text) END"

ORACLES = {
    "content_dedup": f"SELECT doc_id, body_hash FROM (SELECT doc_id, {HASH} AS body_hash, row_number() OVER (PARTITION BY {HASH} ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
    "content_dupe_pairs": f"WITH h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {HASH}) AS original FROM documents) SELECT doc_id AS duplicate, original FROM h WHERE doc_id <> original",
    "mail_parse": f"WITH {MAIL} SELECT file_path, message_id, sender, sender_name, {TO} AS recipients, array_to_string({CC}, '|') AS cc, subject, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, body_hash, CAST(length(body) AS BIGINT) AS body_len, {FORWARD} AS is_forward, {REPLY} AS is_reply, mailbox FROM art",
    "mail_prompt": f"WITH {MAIL} SELECT file_path, md5('Find the entities and claims of this message.' || chr(10) || 'From: ' || sender || ' (' || sender_name || ')' || chr(10) || 'To: ' || array_to_string(list_transform(string_split(to_raw, ','), lambda x: lower(trim(x))), ', ') || chr(10) || 'Cc: ' || array_to_string(({CC})[1:5], ', ') || chr(10) || 'Subject: ' || subject || chr(10) || 'Date: ' || strftime(date, '%Y-%m-%d %H:%M:%S') || chr(10) || 'Forward: ' || CAST({FORWARD} AS VARCHAR) || chr(10) || 'Reply: ' || CAST({REPLY} AS VARCHAR) || chr(10) || chr(10) || left(body, 2000)) AS prompt_md5 FROM art",
    "json_validate_entities": "SELECT * FROM (VALUES ('fenced', 0, 'Ann Lee', 'person', 'A. Lee|Ann'), ('talk', 0, 'Acme', 'organization', ''), ('mixed', 1, 'Plan B', 'project', '')) t(id, pos, name, entity_type, aliases) UNION ALL SELECT 'event:' || event_id, 0, 'user ' || user_id, CASE event_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'topic' ELSE 'meeting' END, '' FROM events WHERE event_id % 4 <> 2",
    "json_validate_claims": "SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM (VALUES ('fenced', 0, 'works_at', 'Ann Lee', 'Acme', 'x', 0.9), ('talk', 0, 'decided', 'Acme', 'Acme', '', 0.7), ('talk', 1, 'decided', 'Acme', '', '', 0.5), ('mixed', 2, 'part_of', 'Plan B', 'Plan B', '', 1.0)) t(id, pos, claim_type, subject, object, excerpt, confidence) UNION ALL SELECT 'event:' || event_id, 0, CASE event_id % 3 WHEN 0 THEN 'decided' ELSE 'works_on' END, 'user ' || user_id, event_type, '', CAST(event_id % 13 AS DOUBLE) / 10 FROM events WHERE event_id % 3 <> 2 AND event_id % 13 BETWEEN 5 AND 10",
    "normalize_names": f"WITH tok AS ({TOK_DUCKDB}) SELECT DISTINCT name, {NORM.format('name')} AS norm, contains(name, '@') AND contains(name, '.') AS is_email FROM tok",
    "profile_senders": f"WITH {MAIL} SELECT sender, count(*) AS n FROM art GROUP BY sender",
    "profile_folders": f"WITH {MAIL} SELECT 'sent' || CAST(length(subject) % 4 AS VARCHAR) AS folder, count(*) AS n FROM art GROUP BY 1",
    "profile_length_stats": "SELECT min(length(text)) AS min_len, max(length(text)) AS max_len, round(avg(length(text)), 6) AS mean_len, CAST(median(length(text)) AS DOUBLE) AS median_len, round(stddev_samp(length(text)), 6) AS std_len FROM documents",
    "profile_length_buckets": f"WITH b AS (SELECT {LENGTH_CASE} AS bucket FROM documents) SELECT CAST(i AS INTEGER) AS bucket, (SELECT count(*) FROM b WHERE bucket = i) AS n, round(100.0 * (SELECT count(*) FROM b WHERE bucket = i) / greatest((SELECT count(*) FROM b), 1), 6) AS pct FROM range(7) t(i)",
    "profile_dates": "SELECT min(o_orderdate) AS first, max(o_orderdate) AS last, CAST(floor((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400) AS BIGINT) AS days FROM orders",
    "profile_monthly": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, month LIMIT 15",
    "profile_patterns": f"""WITH {MAIL}, s AS (SELECT count(*) AS t, count(*) FILTER (regexp_matches(subject, '(?i)fw:|fwd:')) AS f, count(*) FILTER (regexp_matches(subject, '(?i)re:')) AS r, count(*) FILTER (regexp_matches(body, '(?i)-----\\s*Original Message')) AS o, count(*) FILTER (regexp_matches(body, '(?i)-----\\s*Forwarded by')) AS w FROM art)
SELECT pattern, n, round(100.0 * n / greatest(t, 1), 6) AS pct FROM (SELECT 'forward_subject' AS pattern, f AS n, t FROM s UNION ALL SELECT 'reply_subject', r, t FROM s UNION ALL SELECT 'original_message', o, t FROM s UNION ALL SELECT 'forwarded_by', w, t FROM s)""",
    "profile_recipients": f"WITH {MAIL} SELECT round(avg(len(string_split(to_raw, ','))), 6) AS avg_recipients, max(len(string_split(to_raw, ','))) AS max_recipients, count(*) FILTER (cc_raw <> '') AS with_cc, CAST(0 AS BIGINT) AS with_bcc FROM art",
    "net_edges": f"WITH comm AS ({SQL['comm']}) SELECT sender, recipient, count(*) AS n FROM comm GROUP BY 1, 2",
    "net_top_senders": f"WITH comm AS ({SQL['comm']}) SELECT sender, count(*) AS n FROM comm GROUP BY 1 ORDER BY n DESC, sender LIMIT 30",
    "net_pairs": f"WITH comm AS ({SQL['comm']}), t AS (SELECT sender FROM comm GROUP BY 1 ORDER BY count(*) DESC, sender LIMIT 20) SELECT least(sender, recipient) AS a, greatest(sender, recipient) AS b, count(*) AS score FROM comm WHERE sender IN (SELECT sender FROM t) AND recipient IN (SELECT sender FROM t) GROUP BY 1, 2",
    "subset_select": f"WITH {MAIL} SELECT file_path, mailbox, sender FROM art WHERE mailbox IN (SELECT mailbox FROM art WHERE sender IN ('system@example.com', 'a1@example.com')) OR sender IN ('system@example.com', 'a1@example.com') OR contains(lower(to_raw), 'a1@example.com') OR contains(lower(to_raw), 'system@example.com')",
    "subset_trim": f"WITH {MAIL} SELECT date_trunc('second', date) AS date, count(*) AS n FROM (SELECT date FROM art WHERE (SELECT count(*) FROM art) <= 2000 UNION ALL (SELECT date FROM art WHERE (SELECT count(*) FROM art) > 2000 AND date BETWEEN TIMESTAMP '2000-06-01' AND TIMESTAMP '2001-12-31' ORDER BY date LIMIT 2000)) GROUP BY 1",
    "subset_stats": f"WITH {MAIL} SELECT count(*) AS n, count(DISTINCT sender) AS senders, count(DISTINCT subject) AS subjects, count(*) FILTER ({FORWARD}) AS forwards, count(*) FILTER ({REPLY}) AS replies, round(avg(CAST({REPLY} AS INTEGER)), 6) AS reply_share, round(avg(length(body)), 6) AS mean_len FROM art",
    "er_exact": f"WITH RECURSIVE {EXACT} {GROUPS.format(g='g1', al='al1', so='so1')}",
    "er_name_map": f"WITH RECURSIVE {EXACT} SELECT norm, gid FROM nm1",
    "er_alias": f"WITH RECURSIVE {ALIAS} {GROUPS.format(g='g2', al='al2', so='so2')}",
    "er_similarity_pairs": f"WITH RECURSIVE {ALIAS},{PAIRS} SELECT a, b FROM sim",
    "er_prefix_pairs": f"WITH RECURSIVE {ALIAS},{PREFIX} SELECT a, b FROM pre",
    "er_fuzzy": f"WITH RECURSIVE {FUZZY} {GROUPS.format(g='g3', al='al3', so='so3')}",
    "claims_consolidated": f"WITH RECURSIVE {CLAIMS} SELECT claim_type, s.canonical_name AS subject_name, o.canonical_name AS object_name, cl.detail, cl.confidence, cl.mention_count, evidence_md5 FROM cl JOIN g3 s ON s.gid = cl.s JOIN g3 o ON o.gid = cl.o",
    "claim_type_distribution": f"WITH RECURSIVE {CLAIMS} SELECT claim_type, count(*) AS n FROM cl GROUP BY 1",
    "dedup_stats": f"""WITH RECURSIVE {CLAIMS}, t AS (SELECT (SELECT count(*) FROM mentions) AS raw_entities, (SELECT count(*) FROM g3) AS entities, (SELECT count(*) FROM raw) AS raw_claims, (SELECT count(*) FROM cl) AS claims)
SELECT *, round(raw_entities / greatest(entities, 1), 6) AS entity_ratio, printf('%.1fx', raw_entities / greatest(entities, 1)) AS entity_ratio_text, round(raw_claims / greatest(claims, 1), 6) AS claim_ratio, printf('%.1fx', raw_claims / greatest(claims, 1)) AS claim_ratio_text FROM t""",
    "graph_nodes": f"WITH {KG} SELECT id, canonical_name, entity_type, upper(left(entity_type, 1)) || substr(entity_type, 2) AS label, (SELECT coalesce(string_agg(alias, '|' ORDER BY alias), '') FROM kg_aliases a WHERE a.id = n.id) AS aliases, mention_count FROM kg_nodes n",
    "graph_edges": f"WITH RECURSIVE {CLAIMS} SELECT s.canonical_name AS src_name, o.canonical_name AS dst_name, upper(claim_type) AS rel_type, cl.confidence, cl.mention_count, cl.detail, least(cl.mention_count, 5) AS n_excerpts FROM cl JOIN g3 s ON s.gid = cl.s JOIN g3 o ON o.gid = cl.o",
    "graph_stats_totals": f"WITH {KG}, {ENDS} SELECT 'nodes' AS stat, count(*) AS n FROM kg_nodes UNION ALL SELECT 'relationships', count(*) FROM kg_edges UNION ALL SELECT 'isolated', count(*) FROM kg_nodes WHERE id NOT IN (SELECT id FROM ends)",
    "graph_stats_node_types": f"WITH {KG} SELECT entity_type, count(*) AS n FROM kg_nodes GROUP BY 1",
    "graph_stats_rel_types": f"WITH {KG} SELECT rel_type, count(*) AS n FROM kg_edges GROUP BY 1",
    "graph_degree_top": f"WITH {KG}, {ENDS}, {DEG} SELECT n.id, canonical_name AS name, entity_type AS type, degree FROM deg JOIN kg_nodes n ON n.id = deg.id ORDER BY degree DESC, n.id LIMIT 10",
    "search": f"WITH {KG} SELECT id, canonical_name, entity_type, mention_count FROM kg_nodes n WHERE contains(lower(canonical_name), '00001') OR EXISTS (SELECT 1 FROM kg_aliases a WHERE a.id = n.id AND contains(lower(alias), '00001')) ORDER BY mention_count DESC NULLS FIRST, id LIMIT 10",
    "search_ui": f"WITH {KG} SELECT id, canonical_name, entity_type, mention_count FROM kg_nodes n WHERE contains(lower(canonical_name), 'nation') OR EXISTS (SELECT 1 FROM kg_aliases a WHERE a.id = n.id AND contains(lower(alias), 'nation')) ORDER BY mention_count DESC NULLS FIRST, id LIMIT 15",
    "entity_lookup": f"""WITH {KG}, q(query) AS (VALUES ('customer#000000007'), ('customer.000000009@corp.com'), ('00000'), ('no such name')),
r AS (SELECT query, id, canonical_name, CASE WHEN lower(canonical_name) = query THEN 1 WHEN EXISTS (SELECT 1 FROM kg_aliases a WHERE a.id = n.id AND lower(alias) = query) THEN 2 WHEN contains(lower(canonical_name), query) THEN 3 END AS rank FROM kg_nodes n, q),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, CASE WHEN rank = 3 THEN length(canonical_name) ELSE 0 END, id) AS k FROM r WHERE rank IS NOT NULL)
SELECT query, id, canonical_name, rank FROM o WHERE k = 1""",
    "entity_context": f"WITH {KG}, {REL} SELECT rel.direction, rel.other_id, o.canonical_name AS other_name, o.entity_type AS other_type, rel.rel_type, rel.confidence, rel.mention_count, (SELECT count(*) FROM rel x WHERE x.id = 'nation:7') AS degree FROM rel JOIN kg_nodes o ON o.id = rel.other_id WHERE rel.id = 'nation:7'",
    "entity_detail": f"WITH {KG}, {REL} SELECT * FROM (SELECT direction, other_id, rel_type, confidence, row_number() OVER (PARTITION BY direction ORDER BY confidence DESC, other_id, rel_type) AS place FROM rel WHERE id = 'customer:7')",
    "claims_by_type": f"WITH {KG} SELECT e.src, e.dst, s.canonical_name AS subject, rel_type, o.canonical_name AS object, confidence, e.mention_count FROM (SELECT * FROM kg_edges WHERE rel_type = 'COMMUNICATED_WITH' AND confidence >= 0.6 ORDER BY confidence DESC NULLS FIRST, mention_count DESC NULLS FIRST, src, dst LIMIT 20) e JOIN kg_nodes s ON s.id = e.src JOIN kg_nodes o ON o.id = e.dst",
    "structured_query": f"WITH {KG}, {REL} SELECT direction, other_id, rel_type, confidence FROM rel WHERE id = 'nation:7' AND rel_type = 'WORKS_AT' AND coalesce(confidence, 0) >= 0.5 ORDER BY direction DESC, confidence DESC, other_id LIMIT 20",
    "neighbourhood_nodes": f"WITH {KG}, {REACH2.format(pick=CENTRE, depth=2, cap=50)} SELECT n.id, canonical_name, dist FROM ids JOIN kg_nodes n ON n.id = ids.id",
    "neighbourhood_edges": f"WITH {KG}, {REACH2.format(pick=CENTRE, depth=2, cap=50)} SELECT src, dst, rel_type, confidence FROM kg_edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)",
    "shortest_path": f"""WITH RECURSIVE {KG}, pairs2 AS (SELECT src AS a, dst AS b FROM kg_edges WHERE src <> dst UNION SELECT dst, src FROM kg_edges WHERE src <> dst),
w(id, hops) AS (SELECT 'customer:1', 0 UNION SELECT pairs2.b, w.hops + 1 FROM w JOIN pairs2 ON pairs2.a = w.id WHERE w.hops < 4)
SELECT 'customer:1' AS source, id AS target, min(hops) AS hops FROM w WHERE id = 'region:4' GROUP BY id""",
    "top_degree_subgraph": f"WITH {KG}, {ENDS}, {DEG}, t AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 60) SELECT src, dst, rel_type FROM kg_edges WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)",
    "spotlight": f"WITH {KG}, {REACH2.format(pick=CENTRE, depth=1, cap=40)} SELECT n.id, CASE WHEN n.id = 'nation:7' THEN 30 ELSE greatest(8, least(25, coalesce(mention_count, 0))) END AS size, CASE WHEN n.id = 'nation:7' THEN 3 ELSE 1 END AS border, left(canonical_name, 20) AS label FROM ids JOIN kg_nodes n ON n.id = ids.id",
    "render_nodes": f"WITH {KG} SELECT id, left(canonical_name, 25) AS label, canonical_name || ' (' || entity_type || ')' || chr(10) || 'Mentions: ' || CAST(mention_count AS VARCHAR) AS title, greatest(10, least(40, mention_count)) AS size, {_case('entity_type', NODE_COLOURS, '#BDBDBD')} AS color FROM kg_nodes",
    "render_edges": f"WITH {KG} SELECT src, dst, rel_type AS label, {_case('rel_type', EDGE_COLOURS, '#999')} AS color, round(greatest(1.0, confidence * 3), 6) AS width FROM kg_edges",
    "render_overview": f"WITH {KG}, {ENDS}, {DEG} SELECT n.id, left(canonical_name, 20) AS label, greatest(8, least(50, 2 * degree)) AS size, 1 AS border FROM deg JOIN kg_nodes n ON n.id = deg.id",
    "mail_headers": f"WITH {MAIL} SELECT m.file, regexp_extract(head, '\\nFrom: ([^\\n]*)', 1) AS \"from\", regexp_extract(head, '\\nTo: ([^\\n]*)', 1) AS \"to\", regexp_extract(head, '\\nCc: ([^\\n]*)', 1) AS cc, '' AS bcc, regexp_extract(head, '\\nSubject: ([^\\n]*)', 1) AS subject, regexp_extract(head, '\\nDate: ([^\\n]*)', 1) AS date, regexp_extract(head, '\\nX-From: ([^\\n]*)', 1) AS x_from, '' AS x_to, '' AS x_folder, regexp_extract(head, '\\nX-Origin: ([^\\n]*)', 1) AS x_origin, md5(body) AS body_md5, CAST(NULL AS VARCHAR) AS error FROM mail m",
    "profile_origins": f"WITH {MAIL} SELECT x_origin, count(*) AS n FROM art GROUP BY 1",
    "net_map_edges": f"WITH {MAIL}, r AS (SELECT sender, unnest(string_split(to_raw || ',' || cc_raw, ',')) AS a FROM art) SELECT sender, lower(trim(a)) AS recipient, count(*) AS n FROM r WHERE contains(a, '@') GROUP BY 1, 2",
    "net_map_mailboxes": f"WITH {MAIL} SELECT mailbox, count(*) AS n, count(DISTINCT sender) AS senders FROM art WHERE sender <> '' GROUP BY 1",
    "net_top_pairs": f"WITH comm AS ({SQL['comm']}), t AS (SELECT sender FROM comm GROUP BY 1 ORDER BY count(*) DESC, sender LIMIT 20) SELECT least(sender, recipient) AS a, greatest(sender, recipient) AS b, count(*) AS score FROM comm WHERE sender IN (SELECT sender FROM t) AND recipient IN (SELECT sender FROM t) GROUP BY 1, 2 ORDER BY score DESC, a, b LIMIT 20",
    "claims_skipped": f"WITH RECURSIVE {CLAIMS} SELECT count(*) AS raw_claims, count(*) FILTER (skipped) AS skipped FROM placed",
    "er_top": f"WITH RECURSIVE {FUZZY}, t AS (SELECT * FROM g3 ORDER BY mention_count DESC, gid LIMIT 15) SELECT gid, canonical_name, entity_type, mention_count, (SELECT coalesce(string_agg(a, '|' ORDER BY a), '') FROM (SELECT a FROM al3 x WHERE x.gid = t.gid ORDER BY a LIMIT 3)) AS aliases FROM t",
    "graph_edge_counts": f"WITH RECURSIVE {CLAIMS} SELECT count(*) AS created, CAST(0 AS BIGINT) AS skipped FROM cl",
    "entity_display": f"WITH {KG}, {REL} SELECT place, direction, other_id, rel_type, confidence, n_relationships FROM (SELECT *, row_number() OVER (ORDER BY direction DESC, confidence DESC, other_id, rel_type) AS place, count(*) OVER () AS n_relationships FROM rel WHERE id = 'nation:7') WHERE place <= 15",
    "graph_stats_full": f"""WITH {KG}, {ENDS}, {DEG}, t AS (SELECT n.id, canonical_name AS name, entity_type AS type, degree FROM deg JOIN kg_nodes n ON n.id = deg.id ORDER BY degree DESC, n.id LIMIT 10),
nt AS (SELECT entity_type AS k, count(*) AS n FROM kg_nodes GROUP BY 1), rt AS (SELECT rel_type AS k, count(*) AS n FROM kg_edges GROUP BY 1)
SELECT (SELECT count(*) FROM kg_nodes) AS total_nodes, (SELECT count(*) FROM kg_edges) AS total_relationships, (SELECT string_agg(k || '=' || n, '|' ORDER BY n DESC, k) FROM nt) AS node_types, (SELECT string_agg(k || '=' || n, '|' ORDER BY n DESC, k) FROM rt) AS rel_types,
       (SELECT string_agg(name || ' (' || type || ') ' || degree, '|' ORDER BY degree DESC, id) FROM t) AS top_connected, (SELECT count(*) FROM kg_nodes WHERE id NOT IN (SELECT id FROM ends)) AS isolated_nodes""",
    "graph_stats_json": f"""WITH {KG}, {ENDS}, {DEG}, t AS (SELECT n.id, canonical_name AS name, entity_type AS type, degree FROM deg JOIN kg_nodes n ON n.id = deg.id ORDER BY degree DESC, n.id LIMIT 10),
nt AS (SELECT entity_type AS k, count(*) AS n FROM kg_nodes GROUP BY 1), rt AS (SELECT rel_type AS k, count(*) AS n FROM kg_edges GROUP BY 1)
SELECT '{{"total_nodes":' || (SELECT count(*) FROM kg_nodes) || ',"total_relationships":' || (SELECT count(*) FROM kg_edges) || ',"node_types":{{' || (SELECT string_agg('"' || k || '":' || n, ',' ORDER BY n DESC, k) FROM nt) || '}},"rel_types":{{' || (SELECT string_agg('"' || k || '":' || n, ',' ORDER BY n DESC, k) FROM rt)
       || '}},"top_connected":[' || (SELECT string_agg('{{"name":"' || name || '","type":"' || type || '","degree":' || degree || '}}', ',' ORDER BY degree DESC, id) FROM t) || '],"isolated_nodes":' || (SELECT count(*) FROM kg_nodes WHERE id NOT IN (SELECT id FROM ends)) || '}}' AS json""",
    "shortest_path_nodes": f"{PATH} SELECT step, hop.id, canonical_name AS name, entity_type AS type, rel.rel_type, rel.src, rel.dst FROM hop JOIN kg_nodes n ON n.id = hop.id LEFT JOIN rel USING (step)",
    "render_path": f"{PATH} SELECT string_agg(CASE WHEN rel.rel_type IS NULL THEN '' ELSE ' —[' || rel.rel_type || ']→ ' END || '**' || canonical_name || '** (' || entity_type || ')', '' ORDER BY step) AS path, count(*) AS nodes FROM hop JOIN kg_nodes n ON n.id = hop.id LEFT JOIN rel USING (step)",
    "stream_ingest": f"WITH {MAIL} SELECT message_id, body_hash FROM (SELECT *, row_number() OVER (PARTITION BY body_hash ORDER BY file_path) AS r FROM art) WHERE r = 1",
}
