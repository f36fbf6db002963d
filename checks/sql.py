"""Shared pieces of the SQL the queries are checked against."""

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"
STOP = ["the", "and", "of", "to", "in", "is"]
STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
NULL_TOKENS = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', "
    "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
)


def clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SPACE}', ' ', 'g'))"


FILMS = """films AS (
  SELECT d.doc_id AS id, substring(d.text, 1, 60) AS title, CAST(NULL AS VARCHAR) AS tagline,
    d.text AS overview, d.lang AS genres, d.lang || ', ' || d.source AS keywords,
    CASE WHEN e.event_type = 'error' THEN CAST(e.user_id AS VARCHAR)
         WHEN e.event_type <> 'click' THEN strftime(e.ts, '%Y-%m-%d') END AS release_date,
    e.user_id AS runtime, e.value AS vote_average, d.n_chars AS vote_count,
    CASE l.quality WHEN 1 THEN 'Released' WHEN 0 THEN 'Rumored' END AS status,
    l.toxic = 1 AS adult,
    CASE WHEN l.quality = 1 THEN '/' || d.source END AS poster_path
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN events e ON e.event_id = d.doc_id)"""

CATALOG = FILMS + f""",
catalog AS (
  SELECT * REPLACE ({clean('title')} AS title, {clean('tagline')} AS tagline,
                    {clean('overview')} AS overview, {clean('genres')} AS genres),
    {clean("lower(" + clean('title') + " || ' ' || " + clean('overview') + ")")} AS document
  FROM films WHERE vote_count >= 10 AND length({clean('overview')}) >= 40)"""

TOKENS = CATALOG + f""",
tokens AS (
  SELECT id, list_filter(regexp_extract_all(lower(document), '{TOKEN}'),
                         lambda t: NOT list_contains({STOP_LIST}, t)) AS t FROM catalog)"""

COUNTS = TOKENS + """,
grams AS (
  SELECT id, unnest(t) AS term FROM tokens
  UNION ALL
  SELECT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tokens),
counts AS (SELECT id, term, count(*) AS tf FROM grams GROUP BY ALL)"""

VOCAB = COUNTS + """,
n AS (SELECT count(*) AS n FROM catalog),
freq AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM counts GROUP BY term),
kept AS (SELECT term, df, cf, ln((n + 1) / (df + 1)) + 1 AS idf FROM freq, n
         WHERE df >= 3 AND df <= n * 0.6::DOUBLE ORDER BY cf DESC, term LIMIT 50000),
vocab AS (SELECT *, row_number() OVER (ORDER BY df, term) - 1 AS term_no FROM kept)"""

ROWS = VOCAB + """,
raw_rows AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM counts JOIN vocab USING (term)),
norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM raw_rows GROUP BY id),
wrows AS (SELECT r.id, r.term, r.w / n.norm AS w FROM raw_rows r JOIN norms n ON r.id = n.id)"""

SPARSE_PAIRS = ROWS + """,
pairs AS (SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS s
          FROM wrows a JOIN wrows b ON a.term = b.term AND a.id <> b.id GROUP BY 1, 2),
listed AS (SELECT * FROM pairs WHERE s > 0)"""

SPARSE_EDGES = SPARSE_PAIRS + """,
firsts AS (SELECT id FROM catalog ORDER BY id LIMIT 11),
cand AS (SELECT * FROM listed UNION ALL
  SELECT c.id, f.id, 0.0 FROM catalog c, firsts f WHERE c.id <> f.id
    AND NOT EXISTS (SELECT 1 FROM listed p WHERE p.a = c.id AND p.b = f.id)),
tfidf_edges AS (SELECT a AS movie_id, CAST(rank AS INTEGER) AS rank, b AS neighbour_id, s AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM cand)
  WHERE rank <= 10)"""

DENSE_EDGES = """vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
units AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS norm FROM vecs),
dense_edges AS (SELECT movie_id, CAST(rank AS INTEGER) AS rank, neighbour_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY score DESC, neighbour_id) AS rank
  FROM (SELECT a.id AS movie_id, b.id AS neighbour_id,
          round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 6) AS score
        FROM units a, units b WHERE a.id <> b.id)) WHERE rank <= 10)"""

# Only vectors that belong to a document.
FILM_EDGES = DENSE_EDGES.replace(
    "FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"
)

VECTOR_FILMS = FILMS + """,
vfilms AS (SELECT * REPLACE (CASE WHEN status IS NOT NULL THEN keywords END AS keywords)
           FROM films WHERE id IN (SELECT vec_id FROM embeddings))"""


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}|{SPACE}$', '', 'g')"


def label_set(c: str) -> str:
    return (
        "list_distinct(list_filter(list_transform(string_split(lower(coalesce("
        f"{c}, '')), ','), lambda x: {strip('x')}), lambda x: x <> ''))"
    )


def joined(c: str) -> str:
    """A list as one text, sorted."""
    return f"array_to_string(list_sort({c}), '|')"


def draw(seed: int, key: str, turn: str, below: str) -> str:
    return (
        f"(CAST('0x' || substring(md5('{seed}:' || {key} || ':' || {turn}), 1, 15) AS BIGINT)"
        f" % ({below}))"
    )


def seeded(seed: int, key: str) -> str:
    return f"md5('{seed}:' || {key})"


# Every film that may be asked, and the sample that jobs score.
QUERIES = "queries AS (SELECT id FROM vfilms WHERE vote_count >= 50)"
SAMPLED = (
    "queries AS (SELECT id FROM vfilms WHERE vote_count >= 50 ORDER BY "
    + seeded(42, "id")
    + ", id LIMIT 2000)"
)
