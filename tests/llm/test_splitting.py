import random

import pytest
from pyspark.sql import functions as F

from evispark.llm import splitting as S

PAGES = "page_id string, text string, max_chars int, item_kind string"
CHUNKS = "chunk_id string, section_type string, start_char int, text string, overlap string"
LIMITS = "item_kind string, section_type string, max_chars int, overlap_chars int"
LIMIT_ROWS = [("page", None, 60, 10), ("chunk", None, 40, 5), ("chunk", "Results ", 30, 0), ("chunk", "methods", None, 3), ("page", "results", 5, 0)]


def text_of(rng, n, alphabet):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_pieces_join_whatever_the_ranges_are():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randint(2, 900)
        text = text_of(rng, n, rng.choice(["ab .\n", "x", "字。 ", "a.\n\n b😀"]))
        m, o, size = rng.randint(1, 50), rng.randint(0, 55), rng.randint(1, 300)
        if n <= m:
            continue
        whole = S.pieces_of_range(text, 0, 0, n, n, m, o)
        parts = []
        for first in range(0, n, size):
            base, stop = max(0, first - S._reach(m)), min(n, first + size)
            parts += [(len(parts) + k, a, b) for k, a, b in S.pieces_of_range(text[base : stop + 4], base, first, stop, n, m, o)]
        assert whole == parts
        o = min(o, m - 1)
        assert whole[0][:2] == (1, 0) and whole[-1][2] == n and len(whole) > 1 and [k for k, _, _ in whole] == sorted({k for k, _, _ in whole}) and all(0 < b - a <= m for _, a, b in whole)
        assert all(c == max(0, b - o) and b < d for (_, _, b), (_, c, d) in zip(whole, whole[1:], strict=False))


def test_no_cut_within_words_where_there_is_a_boundary():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["ab ", "xyz", "q" * rng.randint(1, 90), ".\n", "字。"]) for _ in range(rng.randint(1, 120)))
        m, o = rng.randint(20, 60), rng.randint(0, 15)
        pieces = S.pieces_of_range(text, 0, 0, len(text), len(text), m, o) if len(text) > m else []
        for (_, a, b), (_, _, done) in zip(pieces[1:], pieces, strict=False):
            if b < len(text) and not (text[b - 1].isspace() or text[b - 1] in ".。") and b % (S.BLOCK_PIECES * m):
                assert b - a == m and not any(x in text[done:b] for x in " \n。")


def test_cuts_are_at_boundaries():
    text = "One sentence here. " * 40
    for _, _, stop in S.pieces_of_range(text, 0, 0, len(text), len(text), 100, 10)[:-1]:
        assert text[:stop].rstrip().endswith(".")
    assert all(b - a > 50 for _, a, b in S.pieces_of_range(text, 0, 0, len(text), len(text), 100, 10)[:-1])
    text = "没有空格的句子。" * 40
    assert all(text[b - 1] == "。" for _, _, b in S.pieces_of_range(text, 0, 0, len(text), len(text), 50, 5))


@pytest.mark.parametrize("range_bytes", [7, 64, 65536])
def test_table(spark, range_bytes):
    rng = random.Random(5)
    long = text_of(rng, 500, "aé字😀 .\n")
    pages = spark.createDataFrame([("g1", long, 1, "x"), ("g1", long, 1, "x"), ("g2", "a" * 60, 1, "x"), ("g3", None, 1, "x"), ("g4", "", 1, "x"), (None, "b" * 70, 1, None)], PAGES)
    chunks = spark.createDataFrame([("c1", " RESULTS", 100, "y " * 16, "z"), ("c2", None, None, "y " * 30, "z"), ("c3", "methods", 7, "y " * 21, "z"), ("c4", "results", 0, "y" * 30, "z")], CHUNKS)
    out = S.oversized_pieces(pages, chunks, spark.createDataFrame(LIMIT_ROWS, LIMITS), range_bytes).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.piece_no):
        by.setdefault((r.item_kind, r.item_id), []).append(r)
    assert set(by) == {("page", "g1"), ("page", None), ("chunk", "c1"), ("chunk", "c2"), ("chunk", "c3")}
    page = by["page", "g1"]
    assert [r.text for r in page] == [long[r.start_char : r.end_char] for r in page] and page[-1].end_char == 500
    assert by["chunk", "c1"][0].start_char == 100 and by["chunk", "c2"][0].start_char is None and by["chunk", "c1"][0].section_type == " RESULTS"


def test_empty_tables(spark):
    none = S.oversized_pieces(spark.createDataFrame([], PAGES), spark.createDataFrame([], CHUNKS), spark.createDataFrame([], LIMITS))
    assert none.count() == 0
    some = S.oversized_pieces(spark.createDataFrame([("a", "x" * 99, 1, "")], PAGES), spark.createDataFrame([], CHUNKS), spark.createDataFrame([], LIMITS))
    assert some.count() == 0


def test_giant_files(spark, tmp_path):
    rng = random.Random(9)
    text = text_of(rng, 5000, "ab é字😀. \n")
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("short")
    (tmp_path / "c.txt").write_text("")
    files = [f"file://{tmp_path}/{n}.txt" for n in "abc"]
    got = S.split_files(spark, files, 100, 15, range_bytes=333).orderBy("piece_no").collect()
    assert [(r.piece_no, r.start, r.end) for r in got] == S.pieces_of_range(text, 0, 0, len(text), len(text), 100, 15)
    assert all(r.text == text[r.start : r.end] for r in got) and {r.item for r in got} == {files[0]}


def test_very_long_text(spark):
    text = "word and word. " * 60_000
    items = spark.createDataFrame([(1, 3000, 250, text)], "item int, max_chars int, overlap int, text string")
    got = S.split_texts(items).select("start", "end", F.length("text").alias("n")).orderBy("start").collect()
    assert got[0].start == 0 and got[-1].end == len(text) and all(r.n <= 3000 for r in got)
    assert all(b.start == a.end - 250 for a, b in zip(got, got[1:], strict=False))
