"""Sources, sinks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from nearfold import adapters as A
from nearfold.functions import labels as L
from nearfold.functions import text as X
from nearfold.functions import values as V
from nearfold.operators import catalog as C
from nearfold.operators import records as R
from nearfold.scale import scratch_path
from nearfold.sources import files
from nearfold.sources.store import RunStore

QUERIES = {}


def query(name, oracle=None):
    def keep(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return keep


def every_film(spark, sf):
    return C.prepare(A.films(spark, sf), A.EVERY_DOCUMENT, A.DOCUMENT_FIELDS)


def flat(c):
    """A list as one text, sorted."""
    return F.array_join(F.sort_array(c), "|")


def nulled(c):
    return f"CASE WHEN {c} IN {S.NULL_TOKENS} THEN NULL ELSE {c} END"


@query(
    "scan_typed_csv",
    f"WITH {S.FILMS} SELECT id, {nulled('title')} AS title, {nulled('tagline')} AS tagline, "
    f"{nulled('overview')} AS overview, {nulled('genres')} AS genres, {nulled('keywords')} AS keywords, "
    f"{nulled('release_date')} AS release_date, runtime, vote_average, vote_count, "
    "status, adult, poster_path FROM films",
)
def scan_typed_csv(spark, sf):
    path = scratch_path(spark, "films-csv")
    extra = A.films(spark, sf).withColumn("homepage", F.lit("x")).withColumn("budget", F.lit(1))
    files.write_csv(extra, path)
    return files.scan_typed_csv(spark, path)


@query(
    "null_tokens",
    "SELECT p_partkey, "
    "CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'small') THEN NULL ELSE split_part(p_name, ' ', 1) END AS word "
    "FROM part",
)
def null_tokens(spark, sf):
    part = A.table(spark, sf, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    return part.select("p_partkey", V.null_tokens(word, ["red", "small"]).alias("word"))


@query(
    "scan_text_csv",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, "
    "CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS note FROM orders",
)
def scan_text_csv(spark, sf):
    path = scratch_path(spark, "orders-csv")
    note = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority"))
    files.write_csv(
        A.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", note.alias("note")), path
    )
    return files.scan_text_csv(spark, path)


@query("parquet_roundtrip", f"WITH {S.CATALOG} SELECT id, title, document, vote_count FROM catalog")
def parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "catalog")
    every_film(spark, sf).select("id", "title", "document", "vote_count").write.parquet(path)
    return spark.read.parquet(path)


@query(
    "json_report_sink",
    "SELECT event_type AS name, count(*) > 2000 AS passed, CAST(count(*) AS DOUBLE) AS observed, "
    "2000.0::DOUBLE AS threshold FROM events GROUP BY 1",
)
def json_report_sink(spark, sf):
    path = scratch_path(spark, "report-json")
    report = A.table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(
        (F.count(F.lit(1)) > 2000).alias("passed"),
        F.count(F.lit(1)).cast("double").alias("observed"),
        F.lit(2000.0).alias("threshold"),
    )
    files.write_json(report, path)
    return spark.read.schema(report.schema).json(path)


@query(
    "title_index_sink",
    "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CAST(p_size + 1950 AS INTEGER) AS year FROM part",
)
def title_index_sink(spark, sf):
    path = scratch_path(spark, "titles")
    files.write_title_index(A.titles(spark, sf).drop("position"), path)
    return files.read_title_index(spark, path)


@query(
    "csv_sample_sink",
    "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 500",
)
def csv_sample_sink(spark, sf):
    path = scratch_path(spark, "sample-csv")
    customer = A.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    files.write_csv(customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(500), path)
    types = {"c_custkey": "bigint", "c_name": "string", "c_mktsegment": "string", "c_acctbal": "double"}
    return files.scan_typed_csv(spark, path, types)


@query(
    "run_partitioned_store",
    "SELECT event_type AS method, strftime(ts, '%Y-%m-%d') AS run_date, count(*) AS n, "
    "round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def run_partitioned_store(spark, sf):
    root = scratch_path(spark, "store")
    store = RunStore(spark, root)
    events = A.table(spark, sf, "events").select(
        "event_id",
        "value",
        F.col("event_type").alias("method"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_date"),
    )
    events.write.partitionBy("method", "run_date").parquet(store.path("events"))
    # Writing one run again replaces that run alone.
    again = events.where((F.col("method") == "view") & (F.col("run_date") == "2024-01-02"))
    store.write(again.drop("method", "run_date"), "events", "2024-01-02", "view")
    return store.all("events").groupBy("method", "run_date").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "artifact_size",
    """SELECT CAST(sum(strlen(CAST(o_orderkey AS VARCHAR) || ',' || o_orderpriority) + 1) AS DOUBLE) / 1048576 AS artifact_mb
    FROM orders""",
)
def artifact_size(spark, sf):
    """Text, whose bytes SQL can tell: a line for each order."""
    path = scratch_path(spark, "size")
    A.table(spark, sf, "orders").select(F.concat_ws(",", "o_orderkey", "o_orderpriority")).write.text(path)
    return files.artifact_size(spark, path)


@query(
    "keyed_upsert",
    """WITH fresh AS (SELECT o_custkey AS key, max(o_totalprice) AS price, 'new' AS version
         FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
    old AS (SELECT c_custkey AS key, c_acctbal AS price, 'old' AS version FROM customer)
    SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE key NOT IN (SELECT key FROM fresh)""",
)
def keyed_upsert(spark, sf):
    fresh = (
        A.table(spark, sf, "orders")
        .where(F.col("o_orderstatus") == "O")
        .groupBy(F.col("o_custkey").alias("key"))
        .agg(F.max("o_totalprice").alias("price"))
        .withColumn("version", F.lit("new"))
    )
    old = A.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("price"), F.lit("old").alias("version")
    )
    return R.keyed_upsert(old, fresh, "key")


@query(
    "json_records_export",
    f"""WITH {S.CATALOG}
    SELECT CAST(id AS VARCHAR) AS movie_id, title,
      CASE WHEN regexp_matches(substring(release_date, 1, 4), '^[0-9]{{1,4}}$')
           THEN CAST(substring(release_date, 1, 4) AS INTEGER) END AS year,
      poster_path, poster_path IS NOT NULL AS has_poster FROM catalog""",
)
def json_records_export(spark, sf):
    path = scratch_path(spark, "records-json")
    records = R.display_columns(every_film(spark, sf)).drop("key")
    R.records_json(records).select("json").write.text(path)
    lines = spark.read.text(path)
    fields = F.from_json("value", "movie_id string, title string, year int, poster_path string")
    return lines.select(fields.alias("r"), F.contains("value", F.lit('"poster_path"')).alias("has_poster")).select(
        "r.*", "has_poster"
    )


@query(
    "catalog_filter",
    f"""WITH {S.FILMS} SELECT id, vote_count, status FROM films
    WHERE vote_count >= 10 AND status IN ('Released') AND NOT coalesce(adult, false)
      AND length({S.clean('overview')}) >= 40""",
)
def catalog_filter(spark, sf):
    return C.catalog_filter(A.films(spark, sf)).select("id", "vote_count", "status")


@query(
    "collapse_whitespace",
    f"SELECT doc_id, {S.clean('text')} AS text FROM documents",
)
def collapse_whitespace(spark, sf):
    docs = A.table(spark, sf, "documents")
    return docs.select("doc_id", X.collapse_whitespace(F.col("text")).alias("text"))


@query(
    "build_document",
    f"""WITH {S.FILMS} SELECT id, {S.clean("lower(" + " || ' ' || ".join(
        S.clean(c) for c in ("title", "tagline", "overview", "genres")) + ")")} AS document FROM films""",
)
def build_document(spark, sf):
    return C.build_document(A.films(spark, sf)).select("id", "document")


@query(
    "tokenize",
    f"""SELECT doc_id, unnest(regexp_extract_all(lower(text), '{S.TOKEN}')) AS token FROM documents""",
)
def tokenize(spark, sf):
    docs = A.table(spark, sf, "documents")
    return docs.select("doc_id", F.explode(X.tokenize(F.col("text"))).alias("token"))


@query(
    "stop_word_filter",
    f"""SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '{S.TOKEN}'),
      lambda t: NOT list_contains({S.STOP_LIST}, t)), ' ') AS kept FROM conversations""",
)
def stop_word_filter(spark, sf):
    kept = X.drop_stop_words(X.tokenize(F.col("text")), S.STOP)
    return A.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(kept, " ").alias("kept")
    )


@query(
    "ngrams_1_2",
    f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{S.TOKEN}'),
        lambda t: NOT list_contains({S.STOP_LIST}, t)) AS t FROM documents)
    SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS gram
    FROM t""",
)
def ngrams_1_2(spark, sf):
    kept = X.drop_stop_words(X.tokenize(F.col("text")), S.STOP)
    docs = A.table(spark, sf, "documents").select("doc_id", kept.alias("t"))
    return docs.select("doc_id", F.explode(X.ngrams(F.col("t"), 2)).alias("gram"))


# A comma list with blanks, mixed case and repeats out of each part's columns.
CELL = "' ' || p_type || ', ' || p_brand || ' ,, ' || lower(p_type) || ',' || p_name || ', ' || chr(9) || p_brand || chr(160) || ',' || chr(160)"


def cell():
    comma = F.lit(", ")
    return F.concat(
        F.lit(" "), "p_type", comma, "p_brand", F.lit(" ,, "), F.lower("p_type"), F.lit(","), "p_name", comma,
        F.lit("\t"), "p_brand", F.lit("\u00a0,\u00a0"),
    )


@query(
    "parse_label_set",
    f"SELECT p_partkey, {S.joined(S.label_set(CELL))} AS labels FROM part",
)
def parse_label_set(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", flat(L.label_set(cell())).alias("labels"))


@query(
    "split_genres_ordered",
    f"""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(
        CASE WHEN p_size > 10 THEN {CELL} ELSE ' , ' END, ','),
        lambda x: {S.strip('x')}), lambda x: x <> ''), '|') AS g FROM part WHERE p_size > 10
    UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size <= 10""",
)
def split_genres_ordered(spark, sf):
    given = F.when(F.col("p_size") > 10, cell()).otherwise(F.lit(" , "))
    return A.table(spark, sf, "part").select(
        "p_partkey", F.array_join(L.genre_list(given), "|").alias("g")
    )


@query(
    "split_keywords_exact",
    f"""SELECT p_partkey, {S.joined(f"list_distinct(list_filter(list_transform(string_split({CELL}, ', '), lambda x: {S.strip('x')}), lambda x: x <> ''))")} AS k FROM part""",
)
def split_keywords_exact(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", flat(L.keyword_set(cell())).alias("k"))


# Dates, bare numbers of one to six digits, and text.
WHEN = (
    "CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') "
    "WHEN 'O' THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderpriority END"
)


def when():
    status = F.col("o_orderstatus")
    return (
        F.when(status == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(status == "O", F.col("o_orderkey").cast("string"))
        .otherwise(F.col("o_orderpriority"))
    )


@query(
    "year_strict",
    f"""SELECT o_orderkey, CASE WHEN regexp_matches(substring({WHEN}, 1, 4), '^[0-9]{{4}}$')
      THEN CAST(substring({WHEN}, 1, 4) AS INTEGER) END AS year FROM orders""",
)
def year_strict(spark, sf):
    return A.table(spark, sf, "orders").select("o_orderkey", V.year_strict(when()).alias("year"))


@query(
    "year_lenient",
    f"""SELECT o_orderkey, CASE WHEN regexp_matches(substring({WHEN}, 1, 4), '^[0-9]{{1,4}}$')
      THEN CAST(substring({WHEN}, 1, 4) AS INTEGER) END AS year FROM orders""",
)
def year_lenient(spark, sf):
    return A.table(spark, sf, "orders").select("o_orderkey", V.year_lenient(when()).alias("year"))


@query("overview_short", "SELECT doc_id, substring(text, 1, 200) AS short FROM documents")
def overview_short(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", V.overview_short(F.col("text")).alias("short"))


@query(
    "score_to_decimal",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_extendedprice / 200000.0::DOUBLE, 4) AS DECIMAL(5, 4)) AS VARCHAR) AS score FROM lineitem""",
)
def score_to_decimal(spark, sf):
    score = V.score_decimal(F.col("l_extendedprice") / 200000.0)
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", score.cast("string").alias("score")
    )


@query(
    "is_missing",
    """SELECT o_orderkey, o_orderstatus = 'P' AS blank_text, o_totalprice < 100000 AS no_number,
      l.quality IS NULL AS no_label FROM orders LEFT JOIN labels l ON o_orderkey = l.doc_id""",
)
def is_missing(spark, sf):
    orders = A.table(spark, sf, "orders")
    labels = A.table(spark, sf, "labels").withColumnRenamed("doc_id", "o_orderkey")
    text = F.when(F.col("o_orderstatus") == "P", F.lit(" \t\u00a0")).otherwise(F.col("o_orderpriority"))
    number = F.when(F.col("o_totalprice") < 100000, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    df = orders.join(labels, "o_orderkey", "left").select(
        "o_orderkey", text.alias("t"), number.alias("n"), "quality"
    )
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        "o_orderkey",
        V.is_missing(F.col("t"), kinds["t"]).alias("blank_text"),
        V.is_missing(F.col("n"), kinds["n"]).alias("no_number"),
        V.is_missing(F.col("quality"), kinds["quality"]).alias("no_label"),
    )


def number_bytes(c):
    """ceil(significant digits / 2) + 1 of a number."""
    text = f"trim(regexp_replace(CAST({c} AS VARCHAR), 'e.*$|[-.]', '', 'g'), '0')"
    return f"CAST(ceil(greatest(length({text}), 1) / 2) AS BIGINT) + 1"


RECORD_SIZES = f"""sizes AS (SELECT CAST(p_partkey AS VARCHAR) AS movie_id,
  8 + length(CAST(p_partkey AS VARCHAR)) + 5 + strlen(p_name) + 4 + {number_bytes('p_size + 1950')}
  + 12 + {number_bytes('p_retailprice')}
  + CASE WHEN p_size > 10 THEN 6 + 3 + strlen(p_type) + 1 + strlen(p_brand) + 1 ELSE 0 END
  + 7 + 3 + 1 + (3 + 1 + 2 + length(CAST(p_size AS VARCHAR)) + 1 + 5 + {number_bytes('round(p_size / 100.0::DOUBLE, 4)')})
  AS size_bytes FROM part)"""


def part_records(spark, sf):
    entry = F.struct(
        F.col("p_size").cast("string").alias("id"), V.score_decimal(F.col("p_size") / 100.0).alias("score")
    )
    return A.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("movie_id"),
        F.col("p_name").alias("title"),
        (F.col("p_size") + 1950).alias("year"),
        F.col("p_retailprice").alias("vote_average"),
        F.when(F.col("p_size") > 10, F.array("p_type", "p_brand")).alias("genres"),
        F.array(entry).alias("similar"),
    )


@query("record_size_bytes", f"WITH {RECORD_SIZES} SELECT movie_id, size_bytes FROM sizes")
def record_size_bytes(spark, sf):
    return R.record_sizes(part_records(spark, sf))


@query(
    "write_units",
    f"""WITH {RECORD_SIZES} SELECT count(*) AS records,
      CAST(sum(ceil(size_bytes / 1024)) AS BIGINT) AS write_units FROM sizes""",
)
def write_units(spark, sf):
    return R.write_unit_total(part_records(spark, sf))


@query("normalize_title", f"SELECT doc_id, {S.clean('lower(text)')} AS key FROM documents")
def normalize_title(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.normalize_title(F.col("text")).alias("key"))


@query(
    "display_projection",
    f"""WITH {S.FILMS} SELECT CAST(id AS VARCHAR) AS id,
      CASE WHEN trim(title) <> '' THEN title END AS title,
      CASE WHEN regexp_matches(substring(release_date, 1, 4), '^[0-9]{{1,4}}$')
           THEN CAST(substring(release_date, 1, 4) AS INTEGER) END AS year,
      vote_average AS rating, poster_path,
      CASE WHEN trim(overview) <> '' THEN substring(overview, 1, 200) END AS overview,
      genres AS genres FROM films""",
)
def display_projection(spark, sf):
    shown = R.display_projection(R.display_columns(A.films(spark, sf)))
    return shown.withColumn("genres", F.array_join("genres", "|"))


@query(
    "shared_genres",
    f"""WITH c AS (SELECT p_partkey, list_transform(string_split(p_type || ',' || p_name, ','), lambda x: trim(x)) AS a,
        string_split(replace(p_name, ' ', ',') || ',' || p_type, ',') AS b FROM part)
    SELECT p_partkey, array_to_string(list_filter(a, lambda x: list_contains(b, x)), '|') AS shared FROM c""",
)
def shared_genres(spark, sf):
    a = L.genre_list(F.concat("p_type", F.lit(","), "p_name"))
    b = L.genre_list(F.concat(F.replace("p_name", F.lit(" "), F.lit(",")), F.lit(","), "p_type"))
    part = A.table(spark, sf, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    shared = L.shared_in_order(F.col("a"), F.col("b"))
    return part.select("p_partkey", F.array_join(shared, "|").alias("shared"))


@query(
    "title_index",
    f"""WITH {S.FILMS} SELECT CAST(id AS VARCHAR) AS id, coalesce(title, '') AS title,
      CASE WHEN regexp_matches(substring(release_date, 1, 4), '^[0-9]{{4}}$')
           THEN CAST(substring(release_date, 1, 4) AS INTEGER) END AS year FROM films""",
)
def title_index(spark, sf):
    return R.title_index(A.films(spark, sf))
