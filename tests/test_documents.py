import random

import pytest

from evispark.operators import chunking as C
from evispark.operators import sections as S

PAGES = "paper_id string, page_id string, page_number int, text string"


def pages(spark, *texts):
    return spark.createDataFrame([("p", f"g{i}", i + 1, t) for i, t in enumerate(texts)], PAGES)


@pytest.mark.parametrize("size", [(120, 20), (1500, 150), (160, 100), (1, 0)])
def test_chunks_are_places_of_the_text(size):
    rng = random.Random(1)
    for _ in range(30):
        text = "".join(rng.choice(["word ", "a. ", "\n", "\n\n", "xyz", "。"]) for _ in range(rng.randint(0, 300)))
        spans = list(C.chunk_bounds(text, *size))
        assert all(0 < b - a <= size[0] for a, b in spans)
        assert not text or (spans[0][0] == 0 and spans[-1][1] == len(text))
        assert all(a < c <= b for (a, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_chunk_sizes_are_checked(spark):
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            C.chunk_pages(pages(spark, "x"), *bad)


def test_blank_pages_have_no_chunks(spark):
    assert C.chunk_pages(pages(spark, None, "", " \n ", "a")).count() == 1


def titles(spark, *texts):
    rows = S.detect_sections(pages(spark, *texts)).orderBy("pos").collect()
    return [(r.title, r.section_type) for r in rows], rows


def test_common_headings(spark):
    found, rows = titles(spark, "Abstract\nWe study things in depth here.\nIntroduction\nIt began with a question of scale.", "Methods\nWe did this and that for long.\nResults\nIt worked out rather well in the end.")
    assert found == [("Abstract", "abstract"), ("Introduction", "introduction"), ("Methods", "methods"), ("Results", "results")]
    assert rows[-1].page_end == 2 and rows[0].end_char == rows[1].start_char


def test_subsections_take_the_type_of_their_parent(spark):
    found, _ = titles(spark, "6 Results\nThe results of the study are as follows.\n6.3 Large Models\nThey are large and they are many here.\n6.3.1 Larger Ones\nThey are even larger than the large ones.")
    assert found == [("Results", "results"), ("Large Models", "results"), ("Larger Ones", "results")]


def test_numbers_on_lines_of_their_own(spark):
    assert titles(spark, "2\nOur Approach\nWe take an approach that nobody took before.")[0][0] == ("Our Approach", "methods")


def test_roman_and_bullet_headings(spark):
    found, _ = titles(spark, "II. DATA AND TOOLS\nWe use the data that we found in here.\n■ Experimental Setup\nThe setup is as simple as it can be.")
    assert [f[0] for f in found] == ["DATA AND TOOLS", "Experimental Setup"]


def test_no_headings_make_one_section(spark):
    found, rows = titles(spark, "0.1 0.2\n12 34\nJ. Smith", "Running line\nx", "Running line\ny", "Running line\nz")
    assert found == [("Full Text", "other")] and (rows[0].page_start, rows[0].page_end, rows[0].confidence) == (1, 4, 0.3)


def test_inline_abstract(spark):
    assert titles(spark, "Abstract: we show that things hold.")[0] == [("Abstract", "abstract")]


def test_a_chunk_above_a_heading_gets_the_pages_later_section(spark):
    sections = spark.createDataFrame([("p", 1, "A", "abstract", 1, 0, 2), ("p", 2, "B", "results", 2, 50, 3)], "paper_id string, pos int, title string, section_type string, page_start int, start_char int, page_end int")
    chunks = spark.createDataFrame([("p", "g1", 1, 10), ("p", "g2", 2, 0), ("p", "g2", 2, 60), ("q", "g3", 1, 0)], "paper_id string, page_id string, page_number int, start_char int")
    got = {(r.page_id, r.start_char): r.section_title for r in C.tag_chunks(chunks, sections).collect()}
    assert got == {("g1", 10): "A", ("g2", 0): "B", ("g2", 60): "B", ("g3", 0): None}


def test_a_number_and_its_title_are_one_heading(spark):
    _, rows = titles(spark, "1\nIntroduction\nIt began with a question of scale.\n\n2.\nRelated work\n3\nOur Idea\nWe had the idea on a long walk.")
    assert [(r.title, r.start_char) for r in rows] == [("Introduction", 2), ("Related work", 54), ("Our Idea", 69)]


def test_a_bulleted_name_counts_as_a_name(spark):
    _, rows = titles(spark, "■ Methods\nWe did what we could do here.\n■ Own Tools\nThe tools are made by us.")
    assert [(r.title, r.section_type, r.confidence) for r in rows] == [("Methods", "methods", 0.75), ("Own Tools", "methods", 0.7)]


def test_a_number_alone_counts_as_a_heading_that_follows(spark):
    assert titles(spark, "2 Big Models\n2.1\nTheir Size\nThe size of them is what matters here.")[0] == [("Big Models", "methods"), ("Their Size", "methods")]


def test_a_section_ends_where_the_page_of_the_next_one_ends(spark):
    _, rows = titles(spark, "Abstract\nshort", "Methods\n" + "x" * 100, "tail")
    assert [(r.page_end, r.end_char) for r in rows] == [(2, 108), (3, 4)]
