import uuid

import pytest
from pyspark.sql import functions as F

from evispark.functions import bylines, ids, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column("t").alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "numbers"),
    [("see [1], [2, 4] and [5-7].", [1, 2, 4, 5, 6, 7]), ("[7-5]", []), ("[a] [1–3] [3]", [1, 2, 3]), ("", []), (None, []), ("[99999999999]", [])],
)
def test_cited_numbers(spark, value, numbers):
    assert one(spark, text.cited_numbers, value) == numbers


def test_white_space_is_unicode(spark):
    assert one(spark, text.collapse_ws, " a  b\x1f\n") == "a b"
    assert one(spark, text.clean_metadata_text, " 　 ") is None


def test_lines_keep_their_ends(spark):
    assert one(spark, text.lines_with_ends, "a\r\nb\n\nc d") == ["a\r\n", "b\n", "\n", "c ", "d"]
    assert one(spark, text.lines_with_ends, "a\n") == ["a\n"]


@pytest.mark.parametrize(("value", "year"), [("in 1999 and 2001", 1999), ("x2001", None), ("18999", None), (None, None)])
def test_years(spark, value, year):
    assert one(spark, text.parse_year, value) == year


def test_sentences(spark):
    body = "## Head\n\n- First one. Second? \"x\" no.\n1. Third! Fourth"
    assert one(spark, text.body_sentences, body) == ["First one.", 'Second? "x" no.', "Third!", "Fourth"]


@pytest.mark.parametrize(
    ("title", "kind"),
    [("Materials and Methods", "methods"), (" CONCLUSIONS ", "conclusion"), ("An Ablation of Parts", "results"), ("Something", "methods"), ("Conflict of interest", "other"), ("Prior work on X", "related_work")],
)
def test_section_types(spark, title, kind):
    assert one(spark, text.classify_title, title) == kind


def test_names_of_files(spark):
    row = spark.createDataFrame([("Smith_and_Li-2019-Deep_things.pdf",), ("scan_119966.pdf",)], "n string").select(*[c.alias(k) for k, c in text.metadata_from_name("n").items()]).collect()
    assert tuple(row[0]) == ("Smith and Li", 2019, "Deep things") and tuple(row[1]) == (None, None, "scan 119966")


@pytest.mark.parametrize(("title", "junk"), [("Microsoft Word - x.doc", True), ("pii12 3..9", True), ("ja0123456", True), ("Untitled", True), ("A real title", False)])
def test_titles_of_writing_programs(spark, title, junk):
    assert one(spark, text.is_internal_title, title) is junk


def test_stable_ids_are_uuid5(spark):
    got = spark.range(20).select(ids.stable_id("chunk", F.col("id").cast("string")).alias("u")).collect()
    assert [r.u for r in got] == [str(uuid.uuid5(ids.NAMESPACE, f"chunk:{i}")) for i in range(20)]


def first(spark, page):
    return tuple(spark.createDataFrame([(page,)], "t string").select(*[c.alias(k) for k, c in bylines.first_page_metadata("t").items()]).first())


def test_first_pages(spark):
    assert first(spark, "A study of\nlong titles\nJ. Smith, A. B. Jones* and C. Li\nUniversity of X\nReceived 2004") == ("A study of long titles", ["J. Smith", "A. B. Jones", "C. Li"], 2004)
    assert first(spark, "Eﬃcient Search\nAnna Bell, Carl Dorn,\nEve Fox and Gus Hill\nIda Jones") == ("Efficient Search", ["Anna Bell", "Carl Dorn", "Eve Fox", "Gus Hill"], None)
    assert first(spark, "J. Smith and A. Jones\nin 1999") == (None, [], 1999)  # a byline on the first line has no title before it
    assert first(spark, None) == (None, [], None) and first(spark, "") == (None, [], None)


@pytest.mark.parametrize(
    ("by", "authors"),
    [("Smith et al", ["Smith et al"]), ("Ann Bob Cem", ["Ann", "Bob", "Cem"]), (None, []), (" ", []), ("A.Smith1,2 & B.Jones†", ["A. Smith", "2", "B. Jones"]), ("Smith and Li", ["Smith", "Li"]), ("one Two", ["one Two"])],
)
def test_authors(spark, by, authors):
    assert one(spark, bylines.parse_authors, by) == authors


@pytest.mark.parametrize(("document", "text", "best"), [("Untitled", "Real", "Real"), ("Good", "Other", "Good"), (None, "T", "T"), ("Untitled", None, "Untitled"), ("", "", None)])
def test_best_title(spark, document, text, best):
    assert spark.createDataFrame([(document, text)], "d string, t string").select(bylines.best_title(F.col("d"), F.col("t")).alias("r")).first()["r"] == best
