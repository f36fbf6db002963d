"""DuckDB SQL that must give the same rows as the queries."""

from __future__ import annotations

from nearfold.llm import license_scan as ls
from nearfold.llm import url_rules as ur
from nearfold.llm.license_rules import RULES, over_words


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_rules() -> str:
    """Each rule is tried on each URL."""
    rules = ", ".join(
        f"({quoted(r.name)}, {quoted(r.verdict)}, {quoted(r.pattern)}, {0 if r.is_domain else 1}, "
        f"{-len(r.name) if r.is_domain else int(r.verdict != ur.ALLOW)})"
        for r in ur.DOMAIN_RULES + ur.PATTERN_RULES
    )
    return rf"""WITH rules(name, verdict, pattern, kind, weight) AS (VALUES {rules}),
rests AS (SELECT page_id, url, string_split_regex(substr(url, strpos(url, '://') + 3), '[?#]')[1] AS rest
  FROM pages WHERE contains(url, '://')),
cut AS (SELECT page_id, string_split(rest, '/')[1] AS h, substr(rest, length(string_split(rest, '/')[1]) + 1) AS path FROM rests),
split AS (SELECT p.page_id, coalesce(c.path, '') AS path,
  coalesce(translate(c.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host
  FROM pages p LEFT JOIN cut c USING (page_id)),
fits AS (SELECT s.*, r.*, row_number() OVER (PARTITION BY s.page_id ORDER BY r.kind, r.weight, r.name) AS place
  FROM split s JOIN rules r
  ON regexp_matches(CASE WHEN r.kind = 0 THEN s.host || s.path ELSE lower(s.host || s.path) END, r.pattern))
SELECT s.page_id, s.host, s.path, CASE WHEN f.kind = 0 THEN f.name END AS rule,
  coalesce(f.verdict, '{ur.ALLOW}') AS verdict
FROM split s LEFT JOIN (SELECT * FROM fits WHERE place = 1) f ON f.page_id = s.page_id"""


def license_scan() -> str:
    """Each rule is tried on each text that holds its keyword."""
    rules = ", ".join(
        f"({r.number}, {quoted(r.label)}, {quoted(r.pattern)}, {quoted(r.keyword)}, {r.priority}, {r.weight}::DOUBLE)"
        for r in RULES
    )
    base = ", ".join(f"({quoted(over_words(p))}, {quoted(label)})" for p, label in ls.PHRASES.items())
    any_base = "|".join(over_words(p).strip() for p in ls.PHRASES)

    def bounds(pattern: str) -> str:
        marked = f"regexp_replace(wide, '(' || {pattern} || ')', ' ' || chr(1) || ' \\1 ' || chr(1) || ' ', 'g')"
        words = f"string_split_regex(trim({marked}), ' +')"
        at = f"list_filter(list_transform({words}, lambda w, i: CASE WHEN w = chr(1) THEN i - 1 END), lambda i: i IS NOT NULL)"
        return f"list_transform({at}, lambda i, k: i - (k - 1))"

    return rf"""WITH rules(rule, label, pattern, keyword, priority, weight) AS (VALUES {rules}),
phrases(phrase, label) AS (VALUES {base}),
spaced AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{ls.BETWEEN}', ' ', 'g')) AS t FROM documents),
wide AS (SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n_words,
    ' ' || replace(t, ' ', '  ') || ' ' AS wide FROM spaced),
based AS (SELECT doc_id, {bounds(quoted(f" (?:{any_base}) "))} AS b FROM wide),
places AS (SELECT doc_id, list_filter(b, lambda x, k: k % 2 = 1) AS starts FROM based),
base AS (SELECT doc_id, len(starts) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word FROM places),
base_labels AS (SELECT DISTINCT w.doc_id, p.label FROM wide w JOIN phrases p ON contains(w.wide, p.phrase)),
hits AS (SELECT w.doc_id, r.*, {bounds("r.pattern")} AS b
  FROM wide w JOIN rules r ON contains(w.wide, ' ' || r.keyword || ' ')),
spans AS (SELECT doc_id, rule, label, priority, weight, b[2 * k + 1] AS s, b[2 * k + 2] AS e
  FROM (SELECT *, unnest(range(0, len(b) // 2)) AS k FROM hits)),
bare AS (SELECT * FROM spans o WHERE NOT EXISTS (SELECT 1 FROM spans i
  WHERE i.doc_id = o.doc_id AND i.priority < o.priority AND i.s >= o.s AND i.e <= o.e)),
kept AS (SELECT * FROM bare i WHERE NOT EXISTS (SELECT 1 FROM bare o
  WHERE o.doc_id = i.doc_id AND o.priority <= i.priority AND o.s <= i.s AND o.e >= i.e
    AND (o.s < i.s OR o.e > i.e OR o.priority < i.priority OR o.rule < i.rule))),
labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM
  (SELECT DISTINCT doc_id, label FROM kept UNION SELECT * FROM base_labels) GROUP BY doc_id),
scores AS (SELECT doc_id, max(weight) AS score FROM kept GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM base_labels GROUP BY doc_id)
SELECT w.doc_id, CAST(w.n_words AS BIGINT) AS n_words, CAST(b.n_base AS BIGINT) AS n_base,
  CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
  coalesce(n.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(s.score, 0.0) AS score
FROM wide w JOIN base b USING (doc_id) LEFT JOIN named n USING (doc_id)
LEFT JOIN labels l USING (doc_id) LEFT JOIN scores s USING (doc_id)"""


def mixing() -> str:
    return r"""WITH sizes AS (SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM totals),
weighed AS (SELECT *, r % 3 + 1 AS w, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / (r % 3 + 1) AS full_at
  FROM ranked),
whole AS (SELECT CAST(sum(source_size) AS DOUBLE) AS all_size, sum(w) AS all_w FROM weighed),
levels AS (SELECT weighed.*,
    all_size - coalesce(sum(cap) OVER before, 0) AS level, CAST(all_w - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS rest
  FROM weighed, whole
  WINDOW before AS (ORDER BY full_at, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (SELECT full_at AS at_full, r AS at_r, level AS at_level, rest AS at_rest FROM levels
  WHERE full_at * rest >= level ORDER BY full_at, r LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN at_r IS NULL OR (full_at, r) < (at_full, at_r)
    THEN CAST(cap AS DOUBLE) ELSE w * at_level / at_rest END AS target
  FROM levels LEFT JOIN first ON true),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('20:' || doc_id), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes),
budget AS (SELECT *, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS turns,
    CAST(floor(target) AS BIGINT) % greatest(source_size, 1) AS rest FROM targets)
SELECT p.doc_id, p.source, p.size, b.source_size, b.target,
  CAST(b.turns * p.size + greatest(0, least(p.size, b.rest - p.before)) AS BIGINT) AS taken
FROM placed p JOIN budget b ON p.source IS NOT DISTINCT FROM b.source"""


def near_vectors(cosine: float) -> str:
    return f"""WITH RECURSIVE vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
units AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM vecs WHERE list_dot_product(v, v) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b
  ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {cosine}),
walk AS (SELECT DISTINCT a AS node, a AS other FROM links
  UNION SELECT w.node, l.b FROM walk w JOIN links l ON l.a = w.other),
least AS (SELECT node, min(other) AS component_id FROM walk GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, coalesce(l.component_id, e.vec_id) AS component_id,
  coalesce(l.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least l ON l.node = e.vec_id"""


SHINGLES = r"""words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM common WHERE 100 * i >= 75 * (na + nb - i)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
walk AS (SELECT DISTINCT a AS node, a AS other FROM links
  UNION SELECT w.node, l.b FROM walk w JOIN links l ON l.a = w.other),
least AS (SELECT node, min(other) AS component_id FROM walk GROUP BY node)"""


def near_documents() -> str:
    return f"""WITH RECURSIVE {SHINGLES}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN least l ON l.node = s.doc_id"""


def crc32(text: str) -> str:
    """The checksum, bit by bit: -1 stands for a shift."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {steps}::BIGINT[]), lambda r, x:
  CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))"""


def conversation_trie() -> str:
    """Every prefix of every rebuilt conversation as a list, each node against all nodes it begins."""
    return f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(md5(concat(length(role), ':', role, text)) ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, text))) AS m,
  list(length(text) ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, text))) AS s FROM said GROUP BY conv_id),
borrowing AS (SELECT c.conv_id, c.m, c.s, b.m AS bm, b.s AS bs, CAST({crc32("CAST(c.conv_id AS VARCHAR)")} % 6 AS BIGINT) AS h
  FROM lists c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 100),
rebuilt AS (SELECT conv_id, list_concat(coalesce(bm, [])[1:h], m[h + 1:]) AS m, list_concat(coalesce(bs, [])[1:h], s[h + 1:]) AS s FROM borrowing),
passed AS (SELECT conv_id, unnest(range(0, len(m) + 1)) AS d, m, s FROM rebuilt),
paths AS (SELECT conv_id, d, array_to_string(m[1:d], '') AS node, array_to_string(m[1:d - 1], '') AS above,
  CASE WHEN d = 0 THEN 0 ELSE s[d] END AS size, d = len(m) AS ends FROM passed),
nodes AS (SELECT node, any_value(CASE WHEN d > 0 THEN above END) AS above, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n,
  any_value(size) AS size, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM paths GROUP BY node),
children AS (SELECT above AS node, count(*) AS c FROM nodes WHERE above IS NOT NULL GROUP BY above),
counted AS (SELECT n.*, coalesce(c.c, 0) AS c FROM nodes n LEFT JOIN children c USING (node)),
upwards AS (SELECT left(node, 32 * CAST(unnest(range(0, depth + 1)) AS INTEGER)) AS node, c = 0 AS leaf, (n - 1) * size AS saved FROM counted),
totals AS (SELECT node, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM upwards GROUP BY node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, n.c AS n_children, t.n_leaves,
  CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN totals t USING (node) LEFT JOIN nodes p ON p.node = n.above"""
