"""SQL for the queries of the reference's own operators."""

from __future__ import annotations

_ITEMS = """
items AS (
  SELECT source AS label, doc_id, n_chars, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, md5(text) AS file_hash,
         source || '/' || doc_id || '.JPG' AS path, least(1.0::DOUBLE, n_chars / 10000.0::DOUBLE) AS quality,
         (n_chars % 1000) / 1000.0::DOUBLE AS sharpness, (doc_id % 97) / 97.0::DOUBLE AS resolution,
         CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split_in
  FROM documents)"""

#: The same with the language as the label, which has more copies.
_BY_LANG = _ITEMS.replace("source AS label", "lang AS label").replace("PARTITION BY source", "PARTITION BY lang").replace("source ||", "lang ||")

_VECTORS = """
counted AS (
  SELECT label, idx, b, count(*) AS c FROM (SELECT label, idx, ('0x' || substr(md5(t), 1, 2))::INT % 64 AS b
    FROM (SELECT label, idx, unnest(string_split(text, ' ')) AS t FROM items)) GROUP BY ALL),
vectors AS (
  SELECT label, idx, list_transform(range(64), lambda k: coalesce(m[k::INT], 0)::DOUBLE) AS v
  FROM (SELECT label, idx, map(list(b), list(c)) AS m FROM counted GROUP BY ALL)),
features AS (
  SELECT i.*, v, array_to_string(list_transform(v, lambda x: CASE WHEN x > list_avg(v) THEN '1' ELSE '0' END), '') AS phash
  FROM items i JOIN vectors USING (label, idx))"""


def _edges(threshold: float, name: str = "edges") -> str:
    return f"""
{name} AS (
  SELECT a.label, a.idx AS i, b.idx AS j, list_cosine_similarity(a.v, b.v) AS sim
  FROM features a JOIN features b ON a.label = b.label AND a.idx < b.idx
  WHERE list_cosine_similarity(a.v, b.v) > {threshold})"""


_BITS = """
bit_edges AS (
  SELECT a.label, a.idx AS i, b.idx AS j, hamming(a.phash, b.phash)::INT AS bits
  FROM features a JOIN features b ON a.label = b.label AND a.idx < b.idx WHERE hamming(a.phash, b.phash) <= 3)"""


def _class_pairs(value: str, measure: str, same: str, where: str, source: str = "features") -> str:
    """Links between the first rows of equal values, and from each first row to the others of its class."""
    return f"""
classes AS (SELECT label, idx, {value} AS x, min(idx) OVER (PARTITION BY label, {value}) AS rep FROM {source}),
firsts AS (SELECT * FROM classes WHERE idx = rep),
class_pairs AS (
  SELECT a.label, a.idx AS i, b.idx AS j, {measure} AS m, false AS copy FROM firsts a JOIN firsts b ON a.label = b.label AND a.idx < b.idx WHERE {measure} {where}
  UNION ALL SELECT label, rep, idx, {same}, true FROM classes WHERE idx <> rep)"""


def _leaders(edges: str, name: str) -> str:
    """A scan by position that carries what is taken."""
    return f"""
{name}_adj AS (SELECT label, i, list(j ORDER BY j) AS js FROM {edges} GROUP BY ALL),
{name}_ends AS (SELECT label, max(i) AS top FROM {edges} GROUP BY ALL),
{name}_walk(label, i, done, grp) AS (
  SELECT label, -1::BIGINT, []::BIGINT[], []::BIGINT[] FROM {name}_ends
  UNION ALL
  SELECT label, pos, CASE WHEN leads THEN list_concat(done, [pos], js) ELSE done END, CASE WHEN leads THEN js ELSE []::BIGINT[] END
  FROM (SELECT *, NOT list_contains(done, pos) AND len(js) > 0 AS leads
        FROM (SELECT w.label, w.i + 1 AS pos, w.done, list_filter(coalesce(a.js, []::BIGINT[]), lambda x: NOT list_contains(w.done, x)) AS js
              FROM {name}_walk w JOIN {name}_ends e ON e.label = w.label AND w.i < e.top LEFT JOIN {name}_adj a ON a.label = w.label AND a.i = w.i + 1))),
{name} AS (SELECT label, i AS leader, list_concat([i], grp) AS members FROM {name}_walk WHERE len(grp) > 0)"""


def _single_pass(groups: str, name: str) -> str:
    return f"""
{name}_fold(label, rest, merged, step) AS (
  SELECT label, list(members ORDER BY group_no), NULL::BIGINT[], 0 FROM {groups} GROUP BY label
  UNION ALL
  SELECT label, list_filter(rest[2:], lambda g: NOT list_has_any(g, rest[1])),
         list_sort(list_distinct(list_concat(rest[1], flatten(list_filter(rest[2:], lambda g: list_has_any(g, rest[1])))))), step + 1
  FROM {name}_fold WHERE len(rest) > 0),
{name} AS (SELECT label, step AS group_no, merged AS members FROM {name}_fold WHERE step > 0)"""


def _components(groups: str, name: str) -> str:
    return f"""
{name}_flat AS (SELECT label, members[1] AS head, unnest(members) AS idx FROM {groups}),
{name}_pairs AS (SELECT DISTINCT label, head AS a, idx AS b FROM {name}_flat UNION SELECT DISTINCT label, idx, head FROM {name}_flat),
{name}_reach(label, a, b) AS (
  SELECT label, a, b FROM {name}_pairs
  UNION
  SELECT r.label, r.a, p.b FROM {name}_reach r JOIN {name}_pairs p ON p.label = r.label AND p.a = r.b),
{name} AS (
  SELECT label, root AS group_no, list(a ORDER BY a) AS members
  FROM (SELECT label, a, min(b) AS root FROM {name}_reach GROUP BY ALL) GROUP BY ALL)"""


def _by_hash(column: str, source: str, name: str) -> str:
    return f"{name} AS (SELECT label, {column} AS hash, count(*) AS n, list(idx ORDER BY idx) AS members FROM {source} GROUP BY ALL HAVING count(*) > 1)"


_LEVELS = (
    "WITH RECURSIVE" + _ITEMS + "," + _VECTORS + "," + _edges(0.95, "near_edges") + "," + _edges(0.85, "var_edges") + "," + _BITS + ","
    + _leaders("near_edges", "near") + "," + _leaders("var_edges", "variation") + "," + _leaders("bit_edges", "perceptual") + """,
levels AS (
  SELECT label, row_number() OVER (PARTITION BY label ORDER BY lv, leader) AS group_no, members
  FROM (SELECT 1 AS lv, * FROM near UNION ALL SELECT 2, * FROM variation UNION ALL SELECT 3, * FROM perceptual))"""
)

_HEADS = "SELECT label, members[1] AS head, len(members) AS n, unnest(members) AS idx FROM m"

_N_TRAIN = "floor(count(*) * 0.75::DOUBLE)::BIGINT"

_QUALITY_SPLIT = f"""
sides AS (
  SELECT i.*, CASE WHEN row_number() OVER (PARTITION BY i.label ORDER BY quality DESC, idx) <= nt THEN 'train' ELSE 'test' END AS split
  FROM items i JOIN (SELECT label, {_N_TRAIN} AS nt FROM items GROUP BY label) USING (label))"""


def _group_split(threshold: float, rest: str) -> str:
    """Groups dealt under capacities, one of them moved where the share is off, then the other rows."""
    return (
        "WITH RECURSIVE" + _ITEMS + "," + _VECTORS + "," + _edges(threshold) + "," + _leaders("edges", "near") + "," + _by_hash("file_hash", "features", "copies") + """,
joined AS (SELECT label, members FROM near UNION ALL SELECT label, members FROM copies),""" + _components("joined", "groups") + f""",
sizes AS (SELECT label, count(*) AS n, {_N_TRAIN} AS nt FROM items GROUP BY label),
sized AS (SELECT label, group_no, members, len(members) AS s, row_number() OVER (PARTITION BY label ORDER BY len(members) DESC, group_no) AS r FROM groups),
deal(label, r, tr, te, split) AS (
  SELECT label, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR FROM sizes
  UNION ALL
  SELECT label, r, tr + CASE WHEN side = 'train' THEN s ELSE 0 END, te + CASE WHEN side = 'test' THEN s ELSE 0 END, side
  FROM (SELECT d.label, g.r, d.tr, d.te, g.s,
               CASE WHEN n - d.tr - d.te <= 0 THEN NULL
                    WHEN (nt - d.tr >= g.s AND CASE WHEN g.s <= nt - d.tr THEN (nt - d.tr)::DOUBLE / (n - d.tr - d.te) ELSE 0.75::DOUBLE END >= 0.5) OR n - nt - d.te < g.s THEN 'train'
                    ELSE 'test' END AS side
        FROM deal d JOIN sized g ON g.label = d.label AND g.r = d.r + 1 JOIN sizes z ON z.label = d.label)),
ends AS (SELECT label, max(tr) AS tr, max(te) AS te FROM deal GROUP BY label),
finals AS (SELECT z.label, n, nt, tr, te, tr + least(greatest(nt - tr, 0), n - tr - te) AS train FROM sizes z JOIN ends USING (label)),
moves AS (
  SELECT label, min_by(r, (s, r)) AS r
  FROM (SELECT g.label, g.r, g.s, d.split, f.* EXCLUDE (label) FROM sized g JOIN deal d ON d.label = g.label AND d.r = g.r JOIN finals f ON f.label = g.label)
  WHERE abs(train / n::DOUBLE - 0.75::DOUBLE) > 0.05 AND split IS NOT NULL AND s <= abs(train - nt)
    AND ((split = 'train' AND train > nt AND abs((train - s) / n::DOUBLE - 0.75::DOUBLE) < abs(train / n::DOUBLE - 0.75::DOUBLE))
      OR (split = 'test' AND train < nt AND abs((train + s) / n::DOUBLE - 0.75::DOUBLE) < abs(train / n::DOUBLE - 0.75::DOUBLE)))
  GROUP BY label),
placed AS (
  SELECT g.label, unnest(g.members) AS idx, CASE WHEN m.r IS NULL THEN d.split WHEN d.split = 'train' THEN 'test' ELSE 'train' END AS split
  FROM sized g JOIN deal d ON d.label = g.label AND d.r = g.r LEFT JOIN moves m ON m.label = g.label AND m.r = g.r WHERE d.split IS NOT NULL),
free AS (SELECT i.*, f.n, f.nt, f.tr, f.te FROM items i JOIN finals f USING (label) ANTI JOIN placed p ON p.label = i.label AND p.idx = i.idx),
dealt AS ({rest})
SELECT label, idx, split FROM placed UNION ALL SELECT label, idx, split FROM dealt"""
    )


_REST_PLAIN = "SELECT label, idx, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY quality DESC, idx) <= nt - tr THEN 'train' ELSE 'test' END AS split FROM free"
_REST_COMPAT = """
  SELECT label, idx, CASE WHEN r < least(u, floor(u * 0.6::DOUBLE), te + u - (n - nt)) AND te + r < n - nt THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY quality DESC, idx) - 1 AS r, n - tr - te AS u FROM free)"""
_REST_INTENDED = """
  SELECT label, idx,
         CASE WHEN d THEN CASE WHEN r < to_train THEN 'train' ELSE 'test' END
              WHEN r < least(cs, floor(cs * 0.6::DOUBLE), te + cd - to_train + cs - (n - nt)) AND te + cd - to_train + r < n - nt THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, greatest(0, least(floor(cd * 0.7::DOUBLE), nt - tr)) AS to_train
        FROM (SELECT *, row_number() OVER (PARTITION BY label, d ORDER BY score, quality DESC, idx) - 1 AS r, count(*) FILTER (d) OVER (PARTITION BY label) AS cd, count(*) FILTER (NOT d) OVER (PARTITION BY label) AS cs
              FROM (SELECT *, doc_id % 3 = 0 AS d, CASE WHEN doc_id % 3 = 0 THEN -((doc_id % 11) / 11.0::DOUBLE) ELSE (doc_id % 13) / 13.0::DOUBLE END AS score FROM free)))"""

_KFOLD = """
placed AS (SELECT i.*, CASE WHEN n // 5 = 0 THEN 4 ELSE least(idx // greatest(n // 5, 1), 4) END::INT AS fold FROM items i JOIN (SELECT label, count(*) AS n FROM items GROUP BY label) USING (label)),
folds AS (SELECT DISTINCT label, f.fold::INT AS fold FROM items, range(5) f(fold)),
per AS (
  SELECT f.label, f.fold, (sum(quality::DECIMAL(18, 9)) FILTER (p.fold <> f.fold))::DOUBLE / count(*) FILTER (p.fold <> f.fold) AS tr, (sum(quality::DECIMAL(18, 9)) FILTER (p.fold = f.fold))::DOUBLE / count(*) FILTER (p.fold = f.fold) AS te, count(*) AS n
  FROM folds f JOIN placed p USING (label) GROUP BY f.label, f.fold),
crossing AS (
  SELECT f.label, f.fold, count(DISTINCT a.file_hash) AS c
  FROM folds f LEFT JOIN placed a ON a.label = f.label AND a.fold = f.fold AND EXISTS (SELECT 1 FROM placed b WHERE b.label = a.label AND b.file_hash = a.file_hash AND b.fold <> a.fold)
  GROUP BY ALL),
means AS (
  SELECT label, avg(coalesce(tr, 'nan'::DOUBLE)) AS train_quality_avg, avg(coalesce(te, 'nan'::DOUBLE)) AS test_quality_avg, avg(abs(coalesce(tr, 'nan'::DOUBLE) - coalesce(te, 'nan'::DOUBLE))) AS train_test_quality_diff, avg(c) AS cross_split_duplicates, max(n) AS n
  FROM per JOIN crossing USING (label, fold) GROUP BY label),
exact AS (SELECT label, count(*) AS k FROM (SELECT label FROM items GROUP BY label, file_hash HAVING count(*) > 1) GROUP BY label),
scored AS (
  SELECT m.*, coalesce(k, 0) / n::DOUBLE AS duplicate_detection_rate,
         (train_quality_avg + test_quality_avg) / 2 * 0.4::DOUBLE + (1.0::DOUBLE - train_test_quality_diff) * 0.3::DOUBLE + coalesce(k, 0) / n::DOUBLE * 0.2::DOUBLE + (1.0::DOUBLE - cross_split_duplicates / 10.0::DOUBLE) * 0.1::DOUBLE AS overall_score
  FROM means m LEFT JOIN exact USING (label))"""

_SCORE = """0.4::DOUBLE * (l_quantity / 50.0::DOUBLE) + 0.15::DOUBLE * (l_extendedprice / 100.0::DOUBLE) + l_extendedprice * (0.15::DOUBLE / 10000.0::DOUBLE) + l_tax * 2.0::DOUBLE * 0.1::DOUBLE + l_discount * 10.0::DOUBLE * 0.1::DOUBLE + l_quantity / 100.0::DOUBLE * 0.1::DOUBLE
         + CASE WHEN l_quantity * 5.0::DOUBLE BETWEEN 100 AND 155 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN l_quantity > 30 THEN 0.03::DOUBLE ELSE 0 END - CASE WHEN l_discount * 4.0::DOUBLE < 0.2::DOUBLE THEN 0.1::DOUBLE ELSE 0 END"""

_CONFIG = "(VALUES (0, 'Default', 0.95::DOUBLE), (1, 'Conservative', 0.98::DOUBLE), (2, 'Aggressive', 0.85::DOUBLE), (3, 'Balanced Split', 0.92::DOUBLE), (4, 'Quality Focused', 0.90::DOUBLE)) c(no, config, t)"

_CONFIGS = "WITH RECURSIVE" + _ITEMS + "," + _VECTORS + "," + _KFOLD + "," + _edges(0.85, "wide") + f""",
edges AS (SELECT label || '|' || no AS label, i, j FROM wide, {_CONFIG} WHERE sim > t),""" + _leaders("edges", "g") + f""",
near AS (SELECT label AS k, count(*) AS near FROM g GROUP BY label),
full_scores AS (SELECT s.*, no, config, duplicate_detection_rate + coalesce(near, 0) / n::DOUBLE AS rate, round(overall_score + coalesce(near, 0) / n::DOUBLE * 0.2::DOUBLE, 9) AS sc FROM scored s, {_CONFIG} LEFT JOIN near ON k = s.label || '|' || no)"""

_RESULTS = """
g AS (SELECT label, count(*) AS d FROM (SELECT label FROM items GROUP BY label, file_hash HAVING count(*) > 1) GROUP BY label),
r AS (SELECT s.label, count(*) AS t, coalesce(max(d), 0) AS d, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'test') AS te FROM sides s LEFT JOIN g USING (label) GROUP BY s.label HAVING te > 0)"""

_GRAYS = """ l AS (SELECT vec_id, label, list_transform(embedding, lambda x: greatest(0, least(255, round((x * 300::FLOAT + 128::FLOAT)::DOUBLE)))::INT) AS v FROM embeddings),
g AS (SELECT *, list_avg(v) AS m, list_stddev_pop(v) AS s, greatest(0.0, (len(list_filter(v, lambda x: x >= 50 AND x < 200)) - 2 * len(list_filter(v, lambda x: x < 10 OR x >= 245))) / len(v)::DOUBLE) AS x FROM l)"""

ORACLES: dict[str, str] = {
    "flagship_dedup_split": "WITH" + _ITEMS + f""",
best AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY label, file_hash ORDER BY quality DESC, idx) = 1)
SELECT label, doc_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY quality DESC, idx) <= nt THEN 'train' ELSE 'test' END AS split
FROM best JOIN (SELECT label, {_N_TRAIN} AS nt FROM best GROUP BY label) USING (label)""",
    "label_inventory": "WITH" + _ITEMS + """, c AS (SELECT label, count(*) FILTER (split_in = 'train') AS train, count(*) FILTER (split_in = 'test') AS test FROM items GROUP BY label)
SELECT label, train, test, label || ' (Train: ' || train || ', Test: ' || test || ')' AS text FROM c ORDER BY label""",
    "counters_pct": "WITH" + _ITEMS + """, c AS (SELECT count(*) FILTER (split_in = 'train') AS train, count(*) FILTER (split_in = 'test') AS test, count(*) AS total FROM items)
SELECT train, test, total, printf('(%.1f%%)', 100.0::DOUBLE * train / total) AS train_pct, printf('(%.1f%%)', 100.0::DOUBLE * test / total) AS test_pct FROM c""",
    "name_truncate": "SELECT p_partkey, CASE WHEN length(p_name) > 15 THEN substr(p_name, 1, 12) || '...' ELSE p_name END AS short_name FROM part",
    "name_sort": """SELECT source AS label, name AS file_name, row_number() OVER (PARTITION BY source ORDER BY lower(name), doc_id) - 1 AS place
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'IMG' ELSE 'img' END || doc_id || '.JPG' AS name FROM documents)""",
    "path_parse": """WITH p AS (SELECT doc_id, source, ['JPG', 'png', 'txt', 'TIFF', 'webp', 'gif'][doc_id % 6 + 1] AS ext FROM documents),
q AS (SELECT *, 'img.' || doc_id || '.' || ext AS name, '/data/train/' || source || '/img.' || doc_id || '.' || ext AS path FROM p)
SELECT doc_id, name AS file_name, source AS label, '.' || lower(ext) AS suffix, 'img.' || doc_id AS stem, lower(ext) IN ('jpg', 'jpeg', 'png', 'bmp', 'gif', 'tiff') AS in_inventory,
       lower(ext) IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'webp') AS in_sorter, CASE WHEN doc_id % 3 > 0 THEN 'img.' || doc_id || '_' || doc_id % 3 || '.' || ext ELSE name END AS numbered,
       '[train] ' || path AS payload, path AS dropped, contains(path, 'train') AS from_train FROM q""",
    "text_lines": "SELECT page_id, length(array_to_string(list_filter(string_split(html, chr(10)), lambda x: NOT starts_with(x, '<')), chr(10)))::INT AS left_chars FROM pages",
    "progress_log": "SELECT event_id, '[' || strftime(ts, '%H:%M:%S') || '] ' || event_type AS line FROM events",
    "config_defaults": "SELECT event_id, coalesce((props->>'$.k')::INT, 8) AS hash_threshold, coalesce((props->>'$.train_ratio')::DOUBLE, 0.75::DOUBLE) AS train_ratio, 0.92::DOUBLE AS near_duplicate_threshold FROM events",
    "settings_merge": "SELECT event_id, coalesce((props->>'$.k')::INT, 0) AS k, 5 AS folds, (2 + len(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'folds'))))::INT AS n FROM events",
    "price_histogram": "SELECT l_returnflag, CASE WHEN l_quantity BETWEEN 0 AND 50 THEN least(floor(l_quantity * 10 / 50.0::DOUBLE), 9)::INT END AS bin, count(*) AS n FROM lineitem GROUP BY ALL",
    "file_hash_groups": "WITH" + _BY_LANG + "," + _by_hash("file_hash", "items", "g") + " SELECT label, hash, n, members[1] AS group_no, unnest(members) AS idx FROM g",
    "phash_groups": "WITH" + _BY_LANG + "," + _VECTORS + "," + _by_hash("phash", "features", "g") + " SELECT label, hash, n, members[1] AS group_no, unnest(members) AS idx FROM g",
    "hamming_pairs": "WITH" + _ITEMS + "," + _VECTORS + "," + _class_pairs("phash", "hamming(a.x, b.x)::INT", "0", "<= 3") + " SELECT label, i, j, m AS bits, copy FROM class_pairs",
    "embedding_pairs": "WITH e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),"
    + _class_pairs("v", "list_cosine_similarity(a.x, b.x)", "1.0::DOUBLE", "> 0.35", "e") + " SELECT label, i, j, round(m, 6) AS sim, copy FROM class_pairs",
    "class_threshold": """
WITH bins AS (SELECT l_returnflag, floor(l_extendedprice / 1000.0::DOUBLE)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
cuts AS (SELECT a.l_returnflag, a.bin, sum(b.n) FILTER (WHERE b.bin <= a.bin) AS n0, sum(b.n * b.bin) FILTER (WHERE b.bin <= a.bin) AS s0, sum(b.n) AS n, sum(b.n * b.bin) AS s FROM bins a JOIN bins b USING (l_returnflag) GROUP BY ALL),
rated AS (SELECT *, ((s0 * n - s * n0)::DOUBLE * (s0 * n - s * n0)::DOUBLE) / (n0 * (n - n0))::DOUBLE AS v FROM cuts WHERE n0 < n)
SELECT l_returnflag, bin AS threshold, n0::BIGINT AS below, (n - n0)::BIGINT AS above, round(v / n::DOUBLE / n::DOUBLE, 6) AS between FROM rated QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY v DESC, bin) = 1""",
    "grid_texture": "WITH" + _GRAYS + """, w AS (SELECT vec_id, list_stddev_pop([v[8 * (r + k // 4) + c + k % 4 + 1] FOR k IN range(16)]) AS d FROM g, (VALUES (0), (2)) a(r), (VALUES (0), (2)) b(c))
SELECT vec_id, count(*) AS windows, round(least(1.0::DOUBLE, avg(d) / 50.0::DOUBLE), 6) AS spread FROM w GROUP BY vec_id""",
    "grid_parts": "WITH RECURSIVE" + _GRAYS + """, bright AS (SELECT vec_id, k // 8 AS r, k % 8 AS c FROM (SELECT vec_id, v, unnest(range(64)) AS k FROM g) WHERE v[k + 1] > 140),
reach(vec_id, r, c, root) AS (
  SELECT vec_id, r, c, 8 * r + c FROM bright
  UNION SELECT b.vec_id, b.r, b.c, x.root FROM reach x JOIN bright b ON b.vec_id = x.vec_id AND abs(b.r - x.r) <= 1 AND abs(b.c - x.c) <= 1),
parts AS (SELECT vec_id, part, count(*) AS n FROM (SELECT vec_id, r, c, min(root) AS part FROM reach GROUP BY ALL) GROUP BY ALL HAVING count(*) > 3)
SELECT vec_id, count(part) AS components, coalesce(max(n), 0) AS largest FROM (SELECT vec_id FROM g) LEFT JOIN parts USING (vec_id) GROUP BY vec_id""",
    "rotated_groups": "WITH" + _ITEMS + "," + _VECTORS + """,
turns AS (SELECT label, idx, phash AS h0, array_to_string([substr(phash, 8 * (7 - k % 8) + k // 8 + 1, 1) FOR k IN range(64)], '') AS h1,
          reverse(phash) AS h2, array_to_string([substr(phash, 8 * (k % 8) + 7 - k // 8 + 1, 1) FOR k IN range(64)], '') AS h3 FROM features),
both_ AS (SELECT label, idx, h0 AS h FROM turns UNION ALL SELECT label, idx + 1000000, CASE idx % 3 WHEN 0 THEN h1 WHEN 1 THEN h2 ELSE h3 END FROM turns WHERE idx % 7 = 0),
named AS (SELECT label, idx, least(h, array_to_string([substr(h, 8 * (7 - k % 8) + k // 8 + 1, 1) FOR k IN range(64)], ''), reverse(h), array_to_string([substr(h, 8 * (k % 8) + 7 - k // 8 + 1, 1) FOR k IN range(64)], '')) AS turned FROM both_),
""" + _by_hash("turned", "named", "groups_") + " SELECT label, hash, n, members[1] AS group_no, unnest(members) AS idx FROM groups_",
    "manifest_versions": """
WITH docs AS (SELECT source AS label, doc_id FROM documents),
moved AS (SELECT min(doc_id) AS doc_id FROM docs),
states AS (
  SELECT 1 AS version, label, 1 AS held, doc_id, doc_id % 5 = 0 AS test FROM docs
  UNION ALL SELECT 2, label, CASE WHEN label IN ('src1', 'src12') THEN 2 ELSE 1 END, doc_id, CASE WHEN label IN ('src1', 'src12') THEN doc_id % 2 = 0 ELSE doc_id % 5 = 0 END FROM docs
  UNION ALL SELECT 3, label, 1, doc_id, doc_id % 5 = 0 FROM docs
  UNION ALL SELECT 4, label, CASE WHEN label = (SELECT label FROM docs JOIN moved USING (doc_id)) THEN 4 ELSE 1 END, d.doc_id, (d.doc_id % 5 = 0) <> (d.doc_id = m.doc_id) FROM docs d, moved m)
SELECT version, label, held, count(*) FILTER (WHERE NOT test) AS train, count(*) FILTER (WHERE test) AS test FROM states GROUP BY ALL""",
    "basket_pairs": """
WITH counts AS (SELECT l_orderkey, (l_partkey % 256)::INT AS b, count(*) AS n FROM lineitem GROUP BY ALL),
o AS (SELECT o_orderkey, o_orderpriority AS label, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS idx FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
baskets AS (SELECT label, idx, list((b, n) ORDER BY b) AS x, sqrt(sum(n * n)) AS norm FROM o JOIN counts ON l_orderkey = o_orderkey GROUP BY ALL),
classes AS (SELECT label, idx, norm, min(idx) OVER (PARTITION BY label, x) AS rep FROM baskets),
firsts AS (SELECT label, idx, norm, b, n FROM classes JOIN o USING (label, idx) JOIN counts ON l_orderkey = o_orderkey WHERE idx = rep),
dots AS (SELECT p.label, p.idx AS i, q.idx AS j, sum(p.n * q.n) / (any_value(p.norm) * any_value(q.norm)) AS sim FROM firsts p JOIN firsts q ON p.label = q.label AND p.b = q.b AND p.idx < q.idx GROUP BY ALL)
SELECT label, i, j, round(sim, 6) AS sim, false AS copy FROM dots WHERE sim > 0.9
UNION ALL SELECT label, rep, idx, 1.0::DOUBLE, true FROM classes WHERE idx <> rep""",
    "leader_groups_perceptual": "WITH RECURSIVE" + _ITEMS + "," + _VECTORS + "," + _BITS + "," + _leaders("bit_edges", "g") + " SELECT label, leader, unnest(members) AS idx FROM g",
    "merge_single_pass": _LEVELS + "," + _single_pass("levels", "m") + " " + _HEADS,
    "merge_components": _LEVELS + "," + _components("levels", "m") + " " + _HEADS,
    "detect_all_levels": "WITH RECURSIVE" + _ITEMS + "," + _VECTORS + "," + _edges(0.95, "e95") + "," + _edges(0.85, "e85") + "," + _edges(0.80, "e80") + "," + _BITS + ","
    + _leaders("e95", "near") + "," + _leaders("e85", "variation") + "," + _leaders("e80", "semantic") + "," + _leaders("bit_edges", "perceptual") + ","
    + _by_hash("file_hash", "features", "files") + "," + _by_hash("phash", "features", "looks") + """,
exact_in AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY lv, members[1]) AS group_no, members FROM (SELECT 1 AS lv, label, members FROM files UNION ALL SELECT 2, label, members FROM looks)),
near_in AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY lv, leader) AS group_no, members FROM (SELECT 1 AS lv, * FROM near UNION ALL SELECT 2, * FROM perceptual)),"""
    + _single_pass("exact_in", "exact_out") + "," + _single_pass("near_in", "near_out") + """,
all_in AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY lv, g) AS group_no, members
  FROM (SELECT 1 AS lv, label, group_no::BIGINT AS g, members FROM exact_out UNION ALL SELECT 2, label, group_no, members FROM near_out UNION ALL SELECT 3, label, leader, members FROM variation UNION ALL SELECT 4, label, leader, members FROM semantic)),"""
    + _single_pass("all_in", "m") + " " + _HEADS,
    "keep_best": "WITH" + _BY_LANG + """ SELECT label, min(idx) AS group_no, arg_min(idx, (-quality, idx)) AS best FROM items GROUP BY label, file_hash HAVING count(*) > 1""",
    "unique_dataset": _LEVELS + "," + _single_pass("levels", "m") + """,
flat AS (SELECT label, group_no, unnest(members) AS idx FROM m),
ranked AS (SELECT f.*, row_number() OVER (PARTITION BY f.label, group_no ORDER BY quality DESC, f.idx) AS r FROM flat f JOIN items i ON i.label = f.label AND i.idx = f.idx)
SELECT label, idx, doc_id FROM items i WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.label = i.label AND r.idx = i.idx AND r.r > 1)""",
    "index_remap": "WITH RECURSIVE" + _ITEMS + "," + _VECTORS + "," + _edges(0.85) + "," + _leaders("edges", "g") + """,
kept AS (SELECT label, idx, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS uidx FROM (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY label, file_hash ORDER BY quality DESC, idx) = 1)),
flat AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY leader) AS group_no, members FROM g),
un AS (SELECT label, group_no, unnest(members) AS idx FROM flat)
SELECT label, group_no, uidx AS idx FROM un JOIN kept USING (label, idx) QUALIFY count(*) OVER (PARTITION BY label, group_no) > 1""",
    "unique_keeping_near": "WITH RECURSIVE" + _ITEMS + "," + _VECTORS + "," + _by_hash("file_hash", "features", "files") + "," + _by_hash("phash", "features", "looks") + """,
exact_in AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY lv, members[1]) AS group_no, members FROM (SELECT 1 AS lv, label, members FROM files UNION ALL SELECT 2, label, members FROM looks)),"""
    + _single_pass("exact_in", "m") + """,
flat AS (SELECT label, group_no, unnest(members) AS idx FROM m),
ranked AS (SELECT f.*, row_number() OVER (PARTITION BY f.label, group_no ORDER BY quality DESC, f.idx) AS r FROM flat f JOIN items i ON i.label = f.label AND i.idx = f.idx)
SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS uidx FROM items i WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.label = i.label AND r.idx = i.idx AND r.r > 1)""",
    "best_image_score": f"""WITH s AS (SELECT *, {_SCORE} AS score,
  list_filter([CASE WHEN l_quantity / 50.0::DOUBLE > 0.7::DOUBLE THEN 'high overall quality' END, CASE WHEN l_extendedprice / 100.0::DOUBLE > 500 THEN 'excellent sharpness' END, CASE WHEN l_extendedprice > 5000 THEN 'high resolution' END,
   CASE WHEN l_tax * 2.0::DOUBLE > 0.15::DOUBLE THEN 'rich detail' END, CASE WHEN l_discount * 10.0::DOUBLE > 0.6::DOUBLE THEN 'vibrant colors' END, CASE WHEN l_quantity * 5.0::DOUBLE BETWEEN 100 AND 155 THEN 'optimal exposure' END], lambda x: x IS NOT NULL) AS reasons FROM lineitem)
SELECT l_orderkey AS group_id, l_linenumber::BIGINT AS best, round(score, 9) AS score, CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, '; ') ELSE 'best available quality' END AS reasons
FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) = 1""",
    "quality_composite": """WITH s AS (SELECT l_returnflag, 0.25::DOUBLE * least(1.0, l_extendedprice / 1000.0::DOUBLE) + 0.15::DOUBLE * (1.0 - abs(l_quantity * 5.0::DOUBLE - 127.0) / 127.0::DOUBLE) + 0.15::DOUBLE * least(1.0, l_quantity / 80.0::DOUBLE)
  + 0.15::DOUBLE * greatest(0.0, 1.0 - l_discount * 100.0::DOUBLE / 10.0::DOUBLE) + 0.10::DOUBLE * least(1.0, l_extendedprice * 100.0::DOUBLE / 12000000.0::DOUBLE) + 0.10::DOUBLE * l_tax + 0.05::DOUBLE * l_discount + 0.05::DOUBLE * l_tax AS s FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(s), 6) AS avg_score, round(max(s), 6) AS max_score FROM s GROUP BY ALL""",
    "vector_histograms": "WITH" + _ITEMS + "," + _VECTORS + """, p AS (SELECT doc_id, v, list_transform(v, lambda x: x / (list_sum(v) + 1e-7::DOUBLE)) AS p, list_avg(v) AS m FROM features)
SELECT doc_id, round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-10::DOUBLE))), 6) AS entropy, round(greatest(0.0, list_sum(p[13:50]) - 2.0::DOUBLE * (list_sum(p[1:3]) + list_sum(p[62:64]))), 6) AS exposure,
       round(m, 6) AS mean, round(sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / 64.0::DOUBLE), 6) AS std, CASE WHEN list_sum(v) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS unit FROM p""",
    "classify_content": """WITH c AS (SELECT coalesce(CASE WHEN l_linenumber <> 7 THEN l_quantity / 50.0::DOUBLE END, 0.5::DOUBLE) AS s, l_discount * 10.0::DOUBLE AS c, coalesce(CASE WHEN l_linenumber < 6 THEN l_linenumber END, 0) AS n, l_quantity FROM lineitem)
SELECT CASE WHEN (s > 0.6::DOUBLE AND c > 0.6::DOUBLE AND n >= 2) OR s > 0.6::DOUBLE * 1.2::DOUBLE THEN 'complex' ELSE 'simple' END AS content_type, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM c GROUP BY ALL""",
    "split_by_quality": "WITH" + _ITEMS + "," + _QUALITY_SPLIT + " SELECT label, idx, split FROM sides",
    "split_group_aware": _group_split(0.95, _REST_PLAIN),
    "split_rebalance": _group_split(0.80, _REST_PLAIN),
    "split_content_compat": _group_split(0.95, _REST_COMPAT),
    "split_content_intended": _group_split(0.95, _REST_INTENDED),
    "verify_cross_split": "WITH" + _BY_LANG + "," + _VECTORS + """
SELECT label, 'file_hash' AS hash_name, count(*) AS conflicts FROM features t WHERE split_in = 'test' AND EXISTS (SELECT 1 FROM features r WHERE r.split_in = 'train' AND r.label = t.label AND r.file_hash = t.file_hash) GROUP BY label
UNION ALL
SELECT label, 'phash', count(*) FROM features t WHERE split_in = 'test' AND EXISTS (SELECT 1 FROM features r WHERE r.split_in = 'train' AND r.label = t.label AND r.phash = t.phash) GROUP BY label""",
    "kfold_assign": "WITH" + _ITEMS + "," + _KFOLD + " SELECT label, idx, fold FROM placed",
    "kfold_metrics": "WITH" + _ITEMS + "," + _KFOLD + " SELECT label, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("train_quality_avg", "test_quality_avg", "train_test_quality_diff", "cross_split_duplicates", "duplicate_detection_rate", "overall_score")) + " FROM scored",
    "config_ranking": _CONFIGS + """
SELECT label, config, sc AS overall_score, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN isnan(sc) THEN NULL ELSE sc END DESC NULLS LAST, no) AS place FROM full_scores""",
    "config_comparison": _CONFIGS + """
SELECT label, config, sc AS overall_score, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN isnan(sc) THEN NULL ELSE sc END DESC NULLS LAST, no) AS place,
       round(train_quality_avg, 9) AS train_quality_avg, round(test_quality_avg, 9) AS test_quality_avg, round(train_test_quality_diff, 9) AS train_test_quality_diff,
       round(rate, 9) AS duplicate_detection_rate, round(cross_split_duplicates, 9) AS cross_split_duplicates FROM full_scores""",
    "split_report": "WITH" + _ITEMS + "," + _QUALITY_SPLIT + """, both_sides AS (SELECT DISTINCT label, s.split FROM items, (VALUES ('train'), ('test')) s(split))
SELECT b.label, b.split, count(s.idx) AS count, round(coalesce(avg(quality), 0.0), 6) AS avg_quality, round(coalesce(avg(sharpness), 0.0), 6) AS avg_sharpness, round(coalesce(avg(resolution), 0.0), 6) AS avg_resolution
FROM both_sides b LEFT JOIN sides s ON s.label = b.label AND s.split = b.split GROUP BY ALL""",
    "ratio_report": "WITH" + _ITEMS + "," + _QUALITY_SPLIT + """
SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test, round(count(*) FILTER (split = 'train') / count(*)::DOUBLE, 6) AS train_ratio, round(abs(count(*) FILTER (split = 'train') / count(*)::DOUBLE - 0.75::DOUBLE), 6) AS deviation FROM sides GROUP BY label""",
    "group_report": "WITH" + _BY_LANG + "," + _by_hash("file_hash", "items", "g") + """,
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY members[1]) - 1 AS group_id FROM g),
flat AS (SELECT label, group_id, n AS size, unnest(members) AS idx FROM n)
SELECT f.label, group_id, size, f.idx, path FROM flat f JOIN items i ON i.label = f.label AND i.idx = f.idx""",
    "groups_per_side": "WITH" + _BY_LANG + "," + _QUALITY_SPLIT + """, g AS (SELECT label, min(idx) AS idx FROM items GROUP BY label, file_hash HAVING count(*) > 1)
SELECT label, count(*) FILTER (split = 'train') AS groups_train, count(*) FILTER (split = 'test') AS groups_test FROM g JOIN sides USING (label, idx) GROUP BY label""",
    "copy_manifest": "WITH" + _ITEMS + """, f AS (SELECT split_in || '/' || label AS folder, 'img' || doc_id % 7 AS stem, file_hash, doc_id FROM items),
once AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY folder, stem, file_hash ORDER BY doc_id) = 1)
SELECT folder, doc_id, stem || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.JPG' AS target_name FROM (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY doc_id) - 1 AS n FROM once)""",
    "move_one": "WITH" + _ITEMS + """ SELECT label, CASE WHEN idx = 0 THEN CASE WHEN split_in = 'train' THEN 'test' ELSE 'train' END ELSE split_in END AS split, count(*) AS n FROM items GROUP BY ALL""",
    "output_recount": "WITH" + _ITEMS + """, once AS (SELECT split_in AS split, count(DISTINCT (label, doc_id % 7, file_hash)) AS written, count(*) AS expected FROM items GROUP BY ALL)
SELECT split, written, expected, written = expected AS matches FROM once""",
    "name_lookup": "WITH" + _ITEMS + """, f AS (SELECT label, split_in, 'img' || doc_id % 7 || '.JPG' AS file_name, path FROM items),
best AS (SELECT label, file_name, arg_min((split_in, path), (split_in <> 'train', path)) AS hit FROM f GROUP BY ALL)
SELECT a.label, 'img' || k || '.JPG' AS file_name, hit[1] AS split, hit[2] AS path FROM (SELECT DISTINCT label FROM items) a CROSS JOIN range(9) r(k) LEFT JOIN best b ON b.label = a.label AND b.file_name = 'img' || k || '.JPG'""",
    "move_report": "WITH" + _ITEMS + "," + _QUALITY_SPLIT + """
SELECT label, path, 'Moved ' || doc_id || '.JPG from ' || split_in || ' to ' || split AS line FROM sides WHERE split <> split_in""",
    "run_totals": "WITH" + _ITEMS + "," + _QUALITY_SPLIT + "," + _RESULTS + """
SELECT count(*) AS labels_processed, sum(t)::BIGINT AS total_images, sum(d)::BIGINT AS duplicates_found, sum(te)::BIGINT AS moved_to_test, sum(tr)::BIGINT AS train_images, sum(te)::BIGINT AS test_images FROM r""",
    "run_lines": "WITH" + _ITEMS + "," + _QUALITY_SPLIT + "," + _RESULTS + """
SELECT label, 'Label ' || chr(39) || label || chr(39) || ': ' || t || ' images processed, ' || d || ' duplicates removed' AS line FROM r""",
    "run_report": "WITH RECURSIVE" + _ITEMS + "," + _VECTORS + "," + _edges(0.95, "near_edges") + "," + _leaders("near_edges", "near") + """,
best AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY label, file_hash ORDER BY quality DESC, idx) = 1),
sides AS (SELECT b.*, CASE WHEN row_number() OVER (PARTITION BY b.label ORDER BY quality DESC, idx) <= nt THEN 'train' ELSE 'test' END AS split
  FROM best b JOIN (SELECT label, floor(count(*) * 0.75::DOUBLE)::BIGINT AS nt FROM best GROUP BY label) USING (label)),
u AS (SELECT label, count(*) AS n, """ + ", ".join(f"count(*) FILTER (split = '{s}') AS {s}_n, count(*) FILTER (split = '{s}' AND doc_id % 10 <> 0) AS {s}_w, " + ", ".join(f"round(coalesce(avg({c}) FILTER (split = '{s}'), 0.0), 6) AS {s}_avg_{c}" for c in ("quality", "sharpness", "resolution")) for s in ("train", "test")) + """ FROM sides GROUP BY label),
e AS (SELECT label, count(*) AS k FROM (SELECT label FROM items GROUP BY label, file_hash HAVING count(*) > 1) GROUP BY label),
g AS (SELECT label, count(*) AS k FROM near GROUP BY label)
SELECT u.label, (SELECT count(*) FROM items i WHERE i.label = u.label) AS original_images_found, u.n AS unique_images_processed, train_w + test_w AS images_copied, coalesce(e.k, 0) AS exact_duplicate_groups, coalesce(g.k, 0) AS near_duplicate_groups,
       true AS remove_exact_duplicates, true AS keep_near_duplicates, train_w AS train_folder_count, test_w AS test_folder_count, train_w + test_w AS total_output_count, u.n AS expected_unique_count,
       train_n AS train_count, train_w AS train_files_copied, test_n AS test_count, test_w AS test_files_copied, train_avg_quality, train_avg_sharpness, train_avg_resolution, test_avg_quality, test_avg_sharpness, test_avg_resolution,
       0.75::DOUBLE AS train_ratio, 'tokens' AS embedding_method
FROM u LEFT JOIN e ON e.label = u.label LEFT JOIN g ON g.label = u.label""",
    "image_levels": "WITH" + _GRAYS + """
SELECT vec_id, round(m, 4) AS brightness, round(s, 4) AS contrast, round(x, 6) AS exposure, len(v)::BIGINT AS pixels FROM g""",
    "image_measures": "WITH" + _GRAYS + """, q AS (SELECT *, list_sum(list_transform(range(2, len(v) + 1), lambda i: abs(v[i] - v[i - 1]))) / (len(v) - 1)::DOUBLE AS steps FROM g)
SELECT vec_id, array_to_string(list_transform(v, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '') AS phash,
       round(0.25::DOUBLE * least(1.0, steps * 10 / 1000.0::DOUBLE) + 0.15::DOUBLE * (1.0 - abs(m - 127.0::DOUBLE) / 127.0::DOUBLE) + 0.15::DOUBLE * least(1.0, s / 80.0::DOUBLE) + 0.15::DOUBLE + 0.10::DOUBLE * (len(v) / 12000000.0::DOUBLE) + 0.05::DOUBLE * x, 6) AS quality,
       round(steps, 4) AS steps, CASE WHEN s / 60.0::DOUBLE > 0.6::DOUBLE * 1.2::DOUBLE THEN 'complex' ELSE 'simple' END AS content_type FROM q""",
    "ssim_neighbours": "WITH" + _GRAYS + """, b AS (SELECT *, lag(v) OVER w AS u, lag(m) OVER w AS k, lag(s) OVER w AS t FROM g WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
c AS (SELECT *, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - m) * (u[i] - k))) / len(v)::DOUBLE AS cov FROM b WHERE u IS NOT NULL)
SELECT vec_id, round((2 * m * k + 6.5025::DOUBLE) * (2 * cov + 58.5225::DOUBLE) / ((m * m + k * k + 6.5025::DOUBLE) * (s * s + t * t + 58.5225::DOUBLE)), 6) AS ssim,
       round(list_cosine_similarity(v, u), 6) AS cosine, list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN (v[i] > m) <> (u[i] > k) THEN 1 ELSE 0 END))::INT AS bits FROM c""",
}
for _name, _t in (("near", 0.95), ("variation", 0.85), ("semantic", 0.80)):
    ORACLES[f"cosine_pairs_{_name}"] = "WITH" + _ITEMS + "," + _VECTORS + "," + _class_pairs("v", "list_cosine_similarity(a.x, b.x)", "1.0::DOUBLE", f"> {_t}") + " SELECT label, i, j, round(m, 6) AS sim, copy FROM class_pairs"
    ORACLES[f"leader_groups_{_name}"] = "WITH RECURSIVE" + _ITEMS + "," + _VECTORS + "," + _edges(_t) + "," + _leaders("edges", "g") + " SELECT label, leader, unnest(members) AS idx FROM g"
