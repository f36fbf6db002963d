from nearfold.operators import catalog as C
from nearfold.operators import profile as P
from nearfold.sources import files

RAW = (
    "id long, title string, tagline string, overview string, genres string, vote_count long, "
    "status string, adult boolean"
)
RULES = {"min_overview_chars": 10, "min_vote_count": 10, "exclude_adult": True, "status": ["Released"]}
LONG = "A long enough overview"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def test_each_rule_drops_its_row(spark):
    df = raw(
        spark,
        (1, "Keep", None, LONG, "Drama", 50, "Released", False),
        (2, "Votes", None, LONG, "Drama", 9, "Released", False),
        (3, "Short", None, "  short \n\n one ", "Drama", 50, "Released", False),
        (4, "Adult", None, LONG, "Drama", 50, "Released", True),
        (5, "Planned", None, LONG, "Drama", 50, "Planned", False),
        (6, "No status", None, LONG, "Drama", 50, None, False),
        (7, "No flag", None, LONG, "Drama", 50, "Released", None),
        (8, "Edge", None, "0123456789", "Drama", 10, "Released", False),
    )
    got = {r.id for r in C.catalog_filter(df, RULES).collect()}
    # "short one" collapses to nine characters; ten are enough.
    assert got == {1, 7, 8}
    counts = {r.rule: r.n for r in P.filter_counts(df, RULES).collect()}
    assert counts == {"votes": 7, "status": 6, "adult": 7, "overview": 7, "all": 3}


def test_document_is_cleaned_lowercased_and_leaves_no_gap(spark):
    df = raw(spark, (1, " The  One ", None, "Line\nTwo  THREE words", "Drama, Crime", 50, "Released", False))
    row = C.prepare(df, RULES).first()
    assert row.document == "the one line two three words drama, crime"
    assert row.title == "The One"
    assert C.build_document(df).first().document == row.document


def test_dedup_keeps_the_most_voted_row(spark):
    df = raw(
        spark,
        (1, "Few", None, LONG, "", 20, "Released", False),
        (1, "Many", None, LONG, "", 50, "Released", False),
        (2, "Other", None, LONG, "", 30, "Released", False),
    )
    got = {r.id: r.title for r in C.dedup_keep_max(df).collect()}
    assert got == {1: "Many", 2: "Other"}


def test_prepare_of_nothing_is_empty(spark):
    assert C.prepare(raw(spark), RULES).count() == 0


def test_typed_csv_reads_named_columns_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "films.csv"
    path.write_text(
        "extra,id,title,overview,vote_count,adult\n"
        'x,1,"Said ""so""","two\nlines",12,True\n'
        "y,2,None,,3,False\n"
        "z,3,n/a,ok,4,\n",
        encoding="utf-8",
    )
    types = {"id": "bigint", "title": "string", "overview": "string", "vote_count": "bigint", "adult": "boolean"}
    rows = [tuple(r) for r in files.scan_typed_csv(spark, str(path), types).orderBy("id").collect()]
    assert rows == [
        (1, 'Said "so"', "two\nlines", 12, True),
        (2, None, None, 3, False),
        (3, None, "ok", 4, None),
    ]
    kept = files.scan_typed_csv(spark, str(path), types, tokens=[""]).where("id = 2").first()
    assert kept.title == "None"
    text = files.scan_text_csv(spark, str(path)).orderBy("id").collect()
    assert [r.overview for r in text] == ["two\nlines", "", "ok"]
    assert text[1].title == "None" and text[2].adult == ""
