"""The queries of the training-data operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

import public_tokenizers

from . import bpe, decontamination, filter_audit, kneser_ney, language, merkle, minhash, ngram_join, pii, quality_rules, secrets, suffix_dedup, warc
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


@query
def op2_secret_scan(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op3_byte_bpe(spark, sf_dir):
    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op4_decontamination(spark, sf_dir):
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_arc_to_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op6_language_id(spark, sf_dir):
    return language.predict(table(spark, sf_dir, "documents"))


@query
def op7_quality_rules(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_quality_classifier(spark, sf_dir):
    found = kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "ppl", "kept")


@query
def op9_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@query
def op10_ngram_join(spark, sf_dir):
    return ngram_join.classes(table(spark, sf_dir, "documents"))


@query
def op11_minmax_dedup(spark, sf_dir):
    return minhash.report(table(spark, sf_dir, "documents"))


@query
def op12_merkle_manifest(spark, sf_dir):
    return merkle.report(table(spark, sf_dir, "documents"))


@query
def op13_filter_audit(spark, sf_dir):
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op4_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.m, win.item_id FROM dw JOIN win USING (m, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
ORACLES["op5_arc_to_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x || '0', i * 5 // 4 + 1, 2) AS INTEGER) >> (3 - CAST(i * 5 % 4 AS INTEGER))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""
ORACLES["op10_ngram_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
ORACLES["op11_minmax_dedup"] = f"SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM ({ORACLES['op10_ngram_join'].replace('least(4,', 'least(5,')})"
ORACLES["op12_merkle_manifest"] = r"""
WITH RECURSIVE b AS (SELECT doc_id, text, coalesce('=' || source, '') AS tree,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
d AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS cut,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, x:
    list_reduce(list_prepend(xor(a, x), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))) AS crc FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS total FROM d),
t(tree, lvl, place, node, total) AS (SELECT tree, 0, place, leaf, total FROM p
  UNION ALL SELECT tree, any_value(lvl) + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(total) + 2) // 3 FROM t WHERE total > 1 GROUP BY tree, place // 3),
s AS (SELECT tree AS name, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS total FROM t WHERE total = 1),
u(lvl, place, node, total) AS (SELECT 0, place, node, total FROM s
  UNION ALL SELECT any_value(lvl) + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(total) + 2) // 3 FROM u WHERE total > 1 GROUP BY place // 3),
root AS (SELECT node AS root FROM u WHERE total = 1),
sib AS (SELECT p.tree, p.place, t.lvl AS lvl, coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place < p.place // CAST(pow(3, t.lvl) AS BIGINT)), '') AS a, coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place > p.place // CAST(pow(3, t.lvl) AS BIGINT)), '') AS z
  FROM p JOIN t ON t.tree = p.tree AND t.total > 1 AND t.place // 3 = p.place // CAST(pow(3, t.lvl + 1) AS BIGINT) GROUP BY 1, 2, 3
  UNION ALL SELECT p.tree, p.place, 100 + u.lvl, coalesce(string_agg(u.node, '' ORDER BY u.place) FILTER (u.place < s.place // CAST(pow(3, u.lvl) AS BIGINT)), ''), coalesce(string_agg(u.node, '' ORDER BY u.place) FILTER (u.place > s.place // CAST(pow(3, u.lvl) AS BIGINT)), '')
  FROM p JOIN s ON s.name = p.tree JOIN u ON u.total > 1 AND u.place // 3 = s.place // CAST(pow(3, u.lvl + 1) AS BIGINT) GROUP BY 1, 2, 3),
proof AS (SELECT tree, place, string_agg(a || z, '' ORDER BY lvl) AS proof, list(a || '|' || z ORDER BY lvl) AS steps FROM sib GROUP BY 1, 2),
f AS (SELECT doc_id, leaf, node AS subroot, coalesce(proof, '') AS proof, list_reduce(list_prepend(CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN cut ELSE leaf END, coalesce(steps, [])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM p LEFT JOIN proof USING (tree, place) JOIN s ON s.name = p.tree)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM f, root
"""
ORACLES["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * strlen(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, f.bit AS own, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE instr(substr(filter_order, 1, step - 1), g.x) > 0) AS before FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o) JOIN f ON f.x = substr(filter_order, step, 1)),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN good AND mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN toxic AND mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS toxic_lost
  FROM c, (SELECT filter_order, step, CAST(own AS BIGINT) AS own, CAST(before AS BIGINT) AS before FROM s) GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
