"""DuckDB SQL with the same rows as the registered queries, where SQL can express them."""

from __future__ import annotations

from .license_rules import KINDS, RULES, SENTENCES
from .link_graph import RULES as URL_RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op4() -> str:
    """Sentences on one line only: SQL has its own way to cut and normalise; the rules are the operator's data."""
    known = ", ".join(f"({_quote(x)}, '{k}')" for k, own in SENTENCES.items() for x in own)
    steps, names = ["s0 AS (SELECT doc_id, ids, ids AS l FROM seq)"], []
    for k, (name, _, own) in enumerate(RULES):
        # each identifier after the place of the one before it
        at, fits = f"list_position(l, '{own[0]}')", [f"list_contains(l, '{own[0]}')"]
        for x in own[1:]:
            step = f"list_position(l[{at} + 1 :], '{x}')"
            fits.append(f"coalesce({step}, 0) > 0")
            at = f"({at} + {step})"
        rest = f"list_filter(l, lambda x: x NOT IN ({', '.join(_quote(x) for x in own)}))"
        steps.append(f"f{k} AS MATERIALIZED (SELECT *, {' AND '.join(fits)} AS r{k} FROM s{k}), s{k + 1} AS (SELECT * REPLACE (CASE WHEN r{k} THEN {rest} ELSE l END AS l) FROM f{k})")
        names.append(f"CASE WHEN r{k} THEN '{name}' END")
    kind = "'none'"
    for want in reversed(KINDS):
        kind = f"CASE WHEN {' OR '.join(f'r{k}' for k, r in enumerate(RULES) if r[1] == want)} THEN '{want}' ELSE {kind} END"
    fired = f"list_filter([{', '.join(names)}], lambda x: x IS NOT NULL)"
    return f"""
WITH known AS (SELECT trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS norm, sid FROM (VALUES {known}) v(s, sid)),
cut AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS p FROM documents),
parts AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS at FROM cut),
found AS (SELECT DISTINCT p.doc_id, p.at, k.sid FROM parts p JOIN known k ON k.norm = trim(regexp_replace(lower(p.s), '[^a-z0-9]+', ' ', 'g'))),
seq AS (SELECT d.doc_id, coalesce(list(f.sid ORDER BY f.at, f.sid) FILTER (f.sid IS NOT NULL), []) AS ids FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id),
{", ".join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_filter({fired}, lambda x, i: list_position({fired}, x) = i), ';') AS licences, {kind} AS kind, CAST(len(l) AS BIGINT) AS n_unexplained FROM s{len(RULES)}"""


def _op9(rounds: int = 150) -> str:
    """Each round's masses are what the last round's send on, summed at the end; after so many rounds nothing is left of them."""
    host = lambda x: f"translate(regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}')"
    rules = ", ".join(f"('{kind}', '{h}', '{p}', '{h}{p}', {len(h + p)})" for kind, h, p in URL_RULES)
    return f"""
WITH RECURSIVE page AS (SELECT page_id, coalesce({host('url')}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
rules(kind, h, p, name, n) AS (VALUES {rules}),
fit AS (SELECT page_id, host, path, arg_max(name, n) AS rule, arg_max(kind, n) AS verdict FROM page LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
link AS (SELECT DISTINCT page_id, host AS src, {host("':' || u")} AS dst FROM (SELECT page_id, host, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*(?:https?:)?(//[^"''\\s>]+)', 1)) AS u FROM page)),
links AS (SELECT src, dst, count(*) AS w FROM link GROUP BY ALL),
hosts AS (SELECT DISTINCT h, string_split(h, '.') AS l FROM (SELECT host AS h FROM page UNION ALL SELECT dst FROM links) WHERE h <> ''),
up AS (SELECT DISTINCT array_to_string(l[i :], '.') AS a, array_to_string(l[i + 1 :], '.') AS b FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM hosts)),
edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM links UNION ALL SELECT a, b, 1 FROM up UNION ALL SELECT b, a, 1 FROM up) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
flows AS (SELECT src AS host, dst AS "to", w / sum(w) OVER (PARTITION BY src) AS wt, CAST(0 AS DOUBLE) AS wd FROM edges UNION ALL SELECT dst, src, 0, w / sum(w) OVER (PARTITION BY dst) FROM edges),
flow AS MATERIALIZED (SELECT host, "to", 0.85 * sum(wt) AS wt, 0.85 * sum(wd) AS wd FROM flows GROUP BY ALL),
seed AS (SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0 END) AS t, avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0 END) AS d FROM fit WHERE host <> '' GROUP BY host),
mass(n, host, t, d) AS (SELECT 0, host, 0.15 * t / (SELECT greatest(sum(t), 1e-300) FROM seed), 0.15 * d / (SELECT greatest(sum(d), 1e-300) FROM seed) FROM seed
  UNION ALL SELECT m.n + 1, f."to", sum(m.t * f.wt), sum(m.d * f.wd) FROM mass m JOIN flow f ON f.host = m.host WHERE m.n < {rounds} GROUP BY m.n + 1, f."to"),
state AS (SELECT host, sum(t) AS t, sum(d) AS d FROM mass GROUP BY host)
SELECT page_id, fit.host, path, rule, coalesce(verdict, CASE WHEN coalesce(d, 0) > coalesce(t, 0) * (1 + 1e-3) THEN 'block' ELSE 'allow' END) AS verdict FROM fit LEFT JOIN state ON state.host = fit.host"""


_WINDOW_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP5 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WINDOW_WORDS} AS w FROM benchmark),
spans AS (SELECT item, w, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS words FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM spans)),
docs AS (SELECT doc_id, {_WINDOW_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
met AS (SELECT s.doc_id, s.i, s.n, x.item FROM starts s JOIN windows x ON x.n = s.n AND x.words = array_to_string(s.w[s.i : s.i + s.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
own AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items, sha256(coalesce(o.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN own o USING (doc_id)"""

OP6 = r"""
WITH docs AS (SELECT doc_id, coalesce('h:' || source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)),
twice AS (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice GROUP BY doc_id),
lines AS (SELECT doc_id, host, line, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS norm
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
frequent AS (SELECT host, norm FROM lines GROUP BY host, norm HAVING count(DISTINCT doc_id) > 10),
gone AS (SELECT doc_id, CAST(sum(len(string_split(norm, ' '))) AS BIGINT) AS n FROM lines JOIN frequent USING (host, norm) GROUP BY doc_id),
fig AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_words
  FROM docs d LEFT JOIN dups USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM fig)
SELECT *, NOT base_failed AND n_words - removed_words >= 20 AND n_words - removed_words >= n_words * 0.5 AS kept FROM base"""

_SHINGLES = f"""
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM docs WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
rare AS (SELECT s, count(*) AS c FROM sh GROUP BY s),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY c, s) AS r FROM sh JOIN rare USING (s)),
prefix AS (SELECT k.doc_id, k.s, z.n FROM ranked k JOIN size z USING (doc_id) WHERE k.r <= z.n - CAST(ceil(0.8 * z.n - 1e-9) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.s = b.s AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
common AS (SELECT c.a, c.b, count(*) AS k FROM cand c JOIN sh x ON x.doc_id = c.a JOIN sh y ON y.doc_id = c.b AND y.s = x.s GROUP BY c.a, c.b),
links AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM docs UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id WHERE r.root < e.b)
"""
OP2 = f"""WITH RECURSIVE {_SHINGLES}
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM docs d LEFT JOIN size z USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""

OP7 = f"""
WITH docs AS (SELECT doc_id, {_BLANK_WORDS.format("text")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM docs),
kept AS (SELECT k.doc_id, string_agg(k.x, ' ' ORDER BY k.p) AS t, count(*) AS n FROM words k ANTI JOIN gone g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)"""


OP3 = f"""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END) AS line,
  generate_subscripts(CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END, 1) AS pos FROM documents),
norm AS (SELECT *, trim(regexp_replace(translate(line, '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS x FROM raw),
occ AS (SELECT doc_id, pos, x FROM norm WHERE length(x) >= 20),
own AS (SELECT x, length(x) AS n, min({{'d': doc_id, 'pos': pos}}) AS first FROM occ GROUP BY x),
edges AS (SELECT a.x AS a, b.x AS b FROM own a JOIN own b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.x <> b.x AND levenshtein(a.x, b.x) <= 2),
reach(x, root) AS (SELECT x, x FROM own UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.x),
class AS (SELECT r.x, min(o.first) AS first FROM reach r JOIN own o ON o.x = r.root GROUP BY r.x),
gone AS (SELECT o.doc_id, o.pos FROM occ o JOIN class c USING (x) WHERE c.first <> {{'d': o.doc_id, 'pos': o.pos}}),
kept AS (SELECT r.doc_id, string_agg(line, chr(10) ORDER BY r.pos) AS t FROM raw r ANTI JOIN gone g ON g.doc_id = r.doc_id AND g.pos = r.pos GROUP BY r.doc_id)
SELECT d.doc_id, (SELECT count(*) FROM raw r WHERE r.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op9_urls": _op9(), "op3_lines": OP3, "op2_near_duplicates": OP2, "op4_licences": _op4(), "op5_decontamination": OP5, "op6_line_quality": OP6, "op7_substrings": OP7}
