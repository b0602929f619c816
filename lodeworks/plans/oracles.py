"""DuckDB SQL with the same rows as the registered queries."""

from __future__ import annotations

from ..functions.hashing import BLOOM, FM, MINHASH, PRIME_BLOOM, PRIME_MINHASH
from ..functions.text import DELETED, STOPWORDS


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


BASKETS = "baskets AS (SELECT DISTINCT l_orderkey AS b, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey)"
EVENTS = "ev AS (SELECT user_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item_id, value FROM events)"
RATINGS = f"{EVENTS}, r AS (SELECT user_id, item_id, avg(value) AS stars FROM ev WHERE event_type <> 'purchase' AND item_id IS NOT NULL GROUP BY ALL)"
TEST = "test AS (SELECT DISTINCT user_id, item_id FROM ev WHERE event_type = 'purchase')"
WORDS = "words AS (SELECT DISTINCT doc_id AS e, unnest(regexp_extract_all(lower(text), '[^ \\t\\n\\r\\x0B\\f]+')) AS m FROM documents)"


def _levels(basket: str, support: str, part: str = "") -> str:
    """Frequent sets of up to five items by self-joins; part: a column of the basket table to count apart."""
    p = f"t1.{part}, " if part else ""
    out = []
    for k in range(1, 6):
        joins = f"{basket} t1" + "".join(f" JOIN {basket} t{j} ON t{j}.b = t1.b AND t{j}.i > t{j - 1}.i" for j in range(2, k + 1))
        items = " || ',' || ".join(f"t{j}.i" for j in range(1, k + 1))
        # a level is only tried on sets whose head is frequent, else the joins grow without use
        keep = f" SEMI JOIN l{k - 1} h ON h.items = {' || chr(44) || '.join(f't{j}.i' for j in range(1, k))}" + (f" AND h.{part} = t1.{part}" if part else "") if k > 1 else ""
        out.append(f"l{k} AS (SELECT {p}{k} AS size, {items} AS items, count(*) AS support FROM {joins}{keep} GROUP BY ALL HAVING {support})")
    return ", ".join(out)


def _itemsets(view: str, support: str) -> str:
    return f"WITH {view}, s AS (SELECT {support} AS s), {_levels('bi', 'count(*) >= (SELECT s FROM s)')} " + " UNION ALL ".join(f"SELECT size, items, support FROM l{k}" for k in range(1, 6))


_SHARE = "CAST(ceil(4 * (SELECT count(DISTINCT b) FROM baskets) / 1000.0) AS BIGINT)"

_KEY = "(CAST('0x' || substr(md5(m), 1, 8) AS BIGINT) % 2147483648)"
_SIG = ", ".join(f"min((({a} * x + {b}) % {PRIME_MINHASH}) % 2147483647) AS m{i}" for i, (a, b) in enumerate(MINHASH))
CLASSES = f"{WORDS}, sets AS (SELECT e, string_agg(m, ' ' ORDER BY m) AS s FROM words GROUP BY e), classes AS (SELECT e, min(e) OVER (PARTITION BY s) AS rep FROM sets)"
SIGNED = f"x AS (SELECT e, {_KEY} AS x FROM own), sig AS (SELECT e, {_SIG} FROM x GROUP BY e), signature AS (SELECT e, [{', '.join(f'm{i}' for i in range(len(MINHASH)))}] AS s FROM sig)"
BANDS = "keyed AS (SELECT e, g, s[g * 2 + 1 : g * 2 + 2] AS k FROM (SELECT e, s, unnest(range(50)) AS g FROM signature)), cand AS (SELECT DISTINCT a.e AS a, b.e AS b FROM keyed a JOIN keyed b ON a.g = b.g AND a.k = b.k AND a.e < b.e)"
OWN = "own AS (SELECT w.e, w.m FROM words w JOIN classes c ON c.e = w.e AND c.rep = w.e)"


def _jaccard(sets: str, threshold: float) -> str:
    return f"""n AS (SELECT e, count(*) AS n FROM {sets} GROUP BY e), c AS (SELECT x.e AS a, y.e AS b, count(*) AS n_common FROM {sets} x JOIN {sets} y ON x.m = y.m AND x.e < y.e GROUP BY ALL),
j AS (SELECT a, b, n_common, n_common / CAST(p.n + q.n - n_common AS DOUBLE) AS sim FROM c JOIN n p ON p.e = a JOIN n q ON q.e = b WHERE n_common / CAST(p.n + q.n - n_common AS DOUBLE) >= {threshold})"""


_STOP = ", ".join(_q(w) for w in STOPWORDS)
TFIDF = f"""tok AS (SELECT source AS biz, unnest(regexp_extract_all(translate(lower(text), {_q(DELETED)}, ''), '[^ \\t\\n\\r\\x0B\\f]+')) AS word FROM documents WHERE source IS NOT NULL),
tf AS (SELECT biz, word, count(*) AS tf FROM tok WHERE word NOT IN ({_STOP}) GROUP BY ALL),
pw AS (SELECT word, count(*) AS df FROM tf GROUP BY word HAVING sum(tf) > 35),
w AS (SELECT tf.biz, tf.word, tf.tf, round(log2((SELECT count(DISTINCT source) FROM documents) / CAST(pw.df AS DOUBLE)) * tf.tf / max(tf.tf) OVER (PARTITION BY tf.biz), 9) AS weight FROM (SELECT *, max(tf) OVER (PARTITION BY biz) AS m FROM tf) tf JOIN pw USING (word)),
prof AS (SELECT biz, word, tf, weight, CAST(row_number() OVER (PARTITION BY biz ORDER BY weight DESC, word DESC) AS INTEGER) AS rank FROM w QUALIFY rank <= 200)"""


def _model(entity: str, by: str) -> str:
    return f"""often AS (SELECT {entity} AS e FROM r GROUP BY 1 HAVING count(*) >= 3), own AS (SELECT r.* FROM r JOIN often ON often.e = r.{entity}),
pairs AS (SELECT x.{entity} AS a, y.{entity} AS b, count(*) AS n, round(coalesce(regr_sxy(x.stars, y.stars) / (sqrt(regr_sxx(x.stars, y.stars)) * sqrt(regr_syy(x.stars, y.stars)) + 1e-11), 0), 6) AS sim
  FROM own x JOIN own y ON x.{by} = y.{by} AND x.{entity} < y.{entity} GROUP BY ALL HAVING count(*) >= 3)"""


ITEM_MODEL = f"{RATINGS}, {_model('item_id', 'user_id')}, model AS (SELECT * FROM pairs WHERE sim > 0)"
USER_MODEL = f"{RATINGS}, {_model('user_id', 'item_id')}, sz AS (SELECT user_id, count(*) AS s FROM r GROUP BY user_id), model AS (SELECT a, b, n, sim FROM pairs JOIN sz p ON p.user_id = a JOIN sz q ON q.user_id = b WHERE sim > 0 AND n >= 0.01 * (p.s + q.s - n))"
BOTH = "ways AS (SELECT a AS e, b AS nb, sim FROM model UNION ALL SELECT b, a, sim FROM model)"
DEV = "sum((stars - avg_nb) * sim) / (sum(abs(sim)) + 1e-10)"
NEAR = f"""{TEST}, {BOTH}, mean AS (SELECT user_id, round(avg(stars), 9) AS avg_nb FROM r GROUP BY user_id),
near AS (SELECT t.user_id, t.item_id, w.nb, w.sim, r.stars, m.avg_nb, CAST(row_number() OVER (PARTITION BY t.user_id, t.item_id ORDER BY w.sim DESC, m.avg_nb DESC, w.nb DESC) AS INTEGER) AS rank
  FROM test t JOIN ways w ON w.e = t.user_id JOIN r ON r.user_id = w.nb AND r.item_id = t.item_id JOIN mean m ON m.user_id = w.nb QUALIFY rank <= 5)"""
BUYERS = f"{EVENTS}, bought AS (SELECT DISTINCT user_id AS e, item_id AS m FROM ev WHERE event_type = 'purchase'), {_jaccard('bought', 0.2)}, edges AS (SELECT a AS src, b AS dst, round(sim, 9) AS weight FROM j UNION ALL SELECT b, a, round(sim, 9) FROM j)"
_LPA = ", ".join(
    f"v{k} AS (SELECT e.dst, l.label, count(*) AS n FROM edges e JOIN l{k} l ON l.id = e.src GROUP BY ALL), h{k} AS (SELECT dst, label FROM v{k} QUALIFY row_number() OVER (PARTITION BY dst ORDER BY n DESC, label) = 1), l{k + 1} AS (SELECT l.id, coalesce(h.label, l.label) AS label FROM l{k} l LEFT JOIN h{k} h ON h.dst = l.id)"
    for k in range(5)
)
BRANDS = f"{BASKETS}, co AS (SELECT x.i AS src, y.i AS dst, count(*) AS w FROM baskets x JOIN baskets y ON x.b = y.b AND x.i <> y.i GROUP BY ALL), g AS (SELECT src, dst FROM co WHERE w > (SELECT avg(w) FROM co))"

STATS = "pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), dims AS (SELECT id, label, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM pts), st AS (SELECT label AS cluster, dim, count(*) AS n, avg(x) AS mean, avg(x * x) AS meansq FROM dims GROUP BY ALL), nr AS (SELECT cluster, CAST(row_number() OVER (ORDER BY cluster) - 1 AS INTEGER) AS k FROM (SELECT DISTINCT cluster FROM st))"


def _assign(scale: str) -> str:
    return f"dist AS (SELECT d.id, nr.k, sqrt(sum((d.x - st.mean) * (d.x - st.mean) / {scale})) AS dist FROM dims d JOIN st USING (dim) JOIN nr ON nr.cluster = st.cluster GROUP BY d.id, nr.k), best AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(dist, 9), k) = 1)"


_BLOOM = " UNION ALL ".join(f"SELECT key, {i} AS row, ((({a} * key + {b}) % {PRIME_BLOOM}) % 250000) AS pos FROM keys" for i, (a, b) in enumerate(BLOOM))
BITS = f"keys AS (SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING'), bits AS (SELECT DISTINCT row, pos FROM ({_BLOOM}))"
_TZ = lambda key, a, b: f"max(CASE WHEN ({a} * CAST({key} AS BIGINT) + {b}) % 4294967296 = 0 THEN 64 ELSE bit_count((({a} * CAST({key} AS BIGINT) + {b}) % 4294967296 & -(({a} * CAST({key} AS BIGINT) + {b}) % 4294967296)) - 1) END)"
_MEANS = ", ".join("(" + " + ".join(f"pow(2.0, {_TZ('user_id', *FM[g * 7 + i])})" for i in range(7)) + ") / 7" for g in range(3))
_EST = f"list_sort([{_MEANS}])[2]"

ORACLES: dict[str, str] = {
    "itemsets_by_brand": _itemsets(f"{BASKETS}, bi AS (SELECT * FROM baskets)", _SHARE),
    "itemsets_inverted": _itemsets(f"{EVENTS}, {TEST}, bi AS (SELECT item_id AS b, CAST(user_id AS VARCHAR) AS i FROM test WHERE item_id IS NOT NULL)", "6"),
    "itemsets_candidates": f"WITH {BASKETS}, bi AS (SELECT *, b % 4 AS p FROM baskets), sz AS (SELECT p, count(DISTINCT b) AS n FROM bi GROUP BY p), {_levels('bi', f'count(*) * (SELECT sum(n) FROM sz) >= (SELECT n FROM sz WHERE sz.p = any_value(t1.p)) * {_SHARE}', 'p')} SELECT DISTINCT size, items FROM (" + " UNION ALL ".join(f"SELECT size, items FROM l{k}" for k in range(1, 6)) + ")",
    "minhash_signature": f"WITH {WORDS}, own AS (SELECT * FROM words), {SIGNED} SELECT e AS doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS i, unnest(s) AS mh FROM signature",
    "lsh_candidates": f"WITH {CLASSES}, {OWN}, {SIGNED}, {BANDS} SELECT a, b FROM cand",
    "lsh_similar_pairs": f"WITH {CLASSES}, {OWN}, {SIGNED}, {BANDS}, n AS (SELECT e, count(*) AS n FROM own GROUP BY e), c AS (SELECT a, b, count(*) AS n_common FROM cand JOIN own x ON x.e = a JOIN own y ON y.e = b AND y.m = x.m GROUP BY ALL) SELECT a, b, n_common, round(n_common / CAST(p.n + q.n - n_common AS DOUBLE), 9) AS sim FROM c JOIN n p ON p.e = a JOIN n q ON q.e = b WHERE n_common / CAST(p.n + q.n - n_common AS DOUBLE) >= 0.5",
    "lsh_set_classes": f"WITH {CLASSES} SELECT e AS entity, rep FROM classes",
    "jaccard_exact": f"WITH {EVENTS}, pd AS (SELECT DISTINCT user_id AS e, strftime(ts, '%Y-%m-%d') AS m FROM ev WHERE event_type = 'purchase'), {_jaccard('pd', 0.5)} SELECT a, b, n_common, round(sim, 9) AS sim FROM j",
    "tfidf_profile": f"WITH {TFIDF} SELECT biz AS business_id, word, tf, round(weight, 6) AS weight, rank FROM prof",
    "content_scores": f"""WITH {TFIDF}, rv AS (SELECT doc_id % 37 AS u, source AS biz FROM documents), us AS (SELECT u FROM rv GROUP BY u HAVING count(*) >= 3),
uw AS (SELECT DISTINCT rv.u, p.word FROM rv JOIN us USING (u) JOIN prof p ON p.biz = rv.biz), nu AS (SELECT u, count(*) AS n FROM uw GROUP BY u), nb AS (SELECT biz, count(*) AS n FROM prof GROUP BY biz),
k AS (SELECT t.u, t.biz, count(*) AS k FROM (SELECT DISTINCT u, biz FROM rv) t JOIN prof p ON p.biz = t.biz JOIN uw ON uw.u = t.u AND uw.word = p.word GROUP BY ALL),
s AS (SELECT k.u, k.biz, round(k.k / (sqrt(nu.n) * sqrt(nb.n)), 9) AS sim FROM k JOIN nu USING (u) JOIN nb USING (biz))
SELECT rv.u AS user_id, rv.biz AS business_id, round(sim, 6) AS sim FROM rv JOIN s USING (u, biz) WHERE sim >= 0.01""",
    "item_cf_model": f"WITH {ITEM_MODEL} SELECT * FROM model",
    "item_cf_predict": f"""WITH {ITEM_MODEL}, {TEST}, {BOTH}, mean AS (SELECT item_id, avg(stars) AS avg_nb FROM r GROUP BY item_id),
known AS (SELECT t.user_id, t.item_id, m.avg_nb AS avg FROM test t JOIN mean m USING (item_id) WHERE t.user_id IN (SELECT user_id FROM r)),
dev AS (SELECT k.user_id, k.item_id, {DEV} AS dev FROM known k JOIN ways w ON w.e = k.item_id JOIN r ON r.user_id = k.user_id AND r.item_id = w.nb JOIN mean m ON m.item_id = w.nb GROUP BY ALL)
SELECT k.user_id, k.item_id, round(k.avg + coalesce(d.dev, 0), 6) AS stars FROM known k LEFT JOIN dev d USING (user_id, item_id)""",
    "user_cf_model": f"WITH {USER_MODEL} SELECT * FROM model",
    "user_cf_predict": f"""WITH {USER_MODEL}, {NEAR}, own_mean AS (SELECT user_id, avg(stars) AS avg FROM r GROUP BY user_id),
known AS (SELECT t.user_id, t.item_id, m.avg FROM test t JOIN own_mean m USING (user_id) WHERE t.item_id IN (SELECT item_id FROM r)), dev AS (SELECT user_id, item_id, {DEV} AS dev FROM near GROUP BY ALL)
SELECT k.user_id, k.item_id, round(k.avg + coalesce(d.dev, 0), 6) AS stars FROM known k LEFT JOIN dev d USING (user_id, item_id)""",
    "top_k_neighbours": f"WITH {USER_MODEL}, {NEAR} SELECT user_id, item_id, nb, sim, rank FROM near",
    "cooccurrence_edges": f"WITH {BASKETS} SELECT x.i AS src, y.i AS dst, count(*) AS weight FROM baskets x JOIN baskets y ON x.b = y.b AND x.i <> y.i GROUP BY ALL HAVING count(*) >= 7",
    "jaccard_graph": f"WITH {BUYERS} SELECT * FROM edges",
    "lpa_communities": f"WITH {BUYERS}, l0 AS (SELECT DISTINCT src AS id, src AS label FROM edges), {_LPA} SELECT id, label FROM l5",
    "connected_components": f"WITH RECURSIVE {BUYERS}, reach(id, root) AS (SELECT DISTINCT src, src FROM edges UNION SELECT e.dst, r.root FROM reach r JOIN edges e ON e.src = r.id) SELECT id, min(root) AS label FROM reach GROUP BY id",
    "edge_betweenness": f"""WITH RECURSIVE {BRANDS}, path(s, t, n, es) AS (SELECT src, dst, 1, [least(src, dst) || '|' || greatest(src, dst)] FROM g
UNION ALL SELECT p.s, g.dst, p.n + 1, list_append(p.es, least(g.src, g.dst) || '|' || greatest(g.src, g.dst)) FROM path p JOIN g ON g.src = p.t WHERE p.n < 4 AND g.dst <> p.s),
short AS (SELECT s, t, es, count(*) OVER (PARTITION BY s, t) AS c FROM (SELECT *, min(n) OVER (PARTITION BY s, t) AS least_n FROM path) WHERE n = least_n),
share AS (SELECT unnest(es) AS e, 1.0 / c AS x FROM short)
SELECT split_part(e, '|', 1) AS src, split_part(e, '|', 2) AS dst, round(sum(x) / 2, 6) AS betweenness FROM share GROUP BY e""",
    "kmeans_assign": f"WITH {STATS}, {_assign('1.0')} SELECT id, k AS cluster, round(dist, 6) AS dist FROM best",
    "kmeans_update": f"WITH {STATS} SELECT cluster, n, CAST(dim AS INTEGER) AS dim, round(mean, 9) AS mean, round(meansq, 9) AS meansq FROM st",
    "bfr_stats": f"WITH {STATS} SELECT CAST(cluster AS INTEGER) AS cluster, CAST(dim AS INTEGER) AS dim, n, round(mean, 9) AS mean, round(greatest(meansq - mean * mean, 1e-9), 9) AS variance FROM st",
    "distinct_truth": "SELECT count(DISTINCT user_id) AS truth FROM events",
    "mahalanobis_assign": f"WITH {STATS}, {_assign('greatest(st.meansq - st.mean * st.mean, 1e-9)')} SELECT id, k AS cluster, round(dist, 6) AS dist, dist <= 2 * sqrt(64) AS inside FROM best",
    "bloom_bits": f"WITH {BITS} SELECT * FROM bits",
    "bloom_probe": f"WITH {BITS}, probes AS (SELECT DISTINCT o_custkey AS key FROM orders), spots AS ({_BLOOM.replace('FROM keys', 'FROM probes')}) SELECT key, count(b.pos) = 10 AS hit FROM spots s LEFT JOIN bits b USING (row, pos) GROUP BY key",
    "fm_estimate": f"SELECT {_EST} AS estimate, count(DISTINCT user_id) AS truth FROM events WHERE user_id IS NOT NULL",
    "fm_sliding_window": f"WITH w AS (SELECT user_id, to_timestamp((CAST(floor(epoch(ts)) AS BIGINT) // 18000 - k) * 18000) AT TIME ZONE 'UTC' AS s FROM events, (SELECT unnest(range(6)) AS k)) SELECT s AS window_start, s + INTERVAL 30 HOUR AS window_end, round({_EST}, 6) AS estimate, count(DISTINCT user_id) AS truth FROM w GROUP BY s",
    "reservoir_bottom_k": "SELECT event_id AS id, event_type AS tag FROM events WHERE event_type IS NOT NULL ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 100",
    "tag_frequency": "SELECT tag, count(*) AS freq FROM (SELECT event_type AS tag FROM events WHERE event_type IS NOT NULL ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 100) GROUP BY tag",
    "id_dictionary": "SELECT id, row_number() OVER (ORDER BY id) - 1 AS code FROM (SELECT DISTINCT c_name AS id FROM customer WHERE c_name IS NOT NULL)",
}
