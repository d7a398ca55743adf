import pytest
from pyspark.sql import functions as F

from evispark.llm import scans as S

PAGES = "page_id string, paper_id string, page_number int, text string, line string, kind string"
PAPERS = "paper_id string, title string, authors array<string>, word string"
PROSE = ["The distributed cache improves the latency of every query.", "Each annotated corpus supports one general hypothesis here.", "Our classifier separates the modern samples from the older ones.", "A statistical model explains the variance of the measured samples."]
#: A first and a last line for each page that no other page has.
OWN = dict(
    enumerate(
        [
            ("Wolves came at night.", "Anna said so herself."),
            ("Nothing but rain fell on that long day in May.", "The old committee met once more and went home early."),
            ("Seven brothers set out to find a river.", "Bo kept the map."),
            ("Grass grows slowly under snow.", "Who would have guessed it without any help from outside?"),
            ("Iron bridges rust where salt water meets them.", "Two engineers agreed on paint."),
            ("A lonely violin played in the yard below us.", "Kim paid for everything, as usual."),
            ("Milk and honey were cheap then.", "Our neighbours moved to a town by the sea."),
        ]
    )
)


def make(spark, pages, papers=()):
    return S.Repair(spark.createDataFrame([(*p, "clash", "x") for p in pages], PAGES), spark.createDataFrame([(*p, "clash") for p in papers], PAPERS))


def book(noise):
    """A paper of six pages under a running line, with page numbers from 41, and ``noise`` on page 3."""
    pages = []
    for n in range(1, 7):
        body = [OWN[n][0], *[PROSE[(n + k) % 4] for k in range(6)], OWN[n][1]]
        pages.append((f"g{n}", "p", n, "\n".join(["Letters of Modern Caches", *body, *(noise if n == 3 else []), f"- {40 + n} -"])))
    return pages


def cases(repair):
    return {(r.page_id, r.line_no, r.noise_kind) for r in repair.found().collect()}


@pytest.mark.parametrize("small", [S.SMALL_CORRECTIONS, -1])
def test_noise_is_found(spark, monkeypatch, small):
    monkeypatch.setattr(S, "SMALL_CORRECTIONS", small)
    noise = ["The distri-", "buted cache improves the high-", "frequency of sarnples and the m0del", "with pre- and post-processing. One gen­", "eral rule."]
    known = ("g9", "q", 1, "\n".join(["The high-frequency part of every general model.", *PROSE * 6, "A distributed high-frequency cache."]))
    got = cases(make(spark, [*book(noise), known], [("p", "Modern Caches", ["A. Smith"])]))
    numbers, headers = {(f"g{n}", 9 + 5 * (n == 3), "page_number") for n in range(1, 7)}, {(f"g{n}", 0, "running_header") for n in range(1, 7)}
    assert got == numbers | headers | {("g3", 9, "broken_word"), ("g3", 12, "broken_word"), ("g3", 11, "misread")}


def test_misread_running_lines_and_numbers(spark):
    pages = book([])
    pages[2] = ("g3", "p", 3, pages[2][3].replace("Modern", "M0dcrn").replace("- 43 -", "- 4З -"))
    pages[4] = ("g5", "p", 5, pages[4][3].replace("Caches", "Cach's").replace("- 45 -", "- 4S -"))
    got = cases(make(spark, pages))
    assert {("g3", 0, "running_header"), ("g5", 0, "running_header"), ("g5", 9, "page_number")} <= got


def test_numbers_beside_running_lines(spark):
    pages = [(f"g{n}", "p", n, "\n".join([f"{n}    Smith et al." if n % 2 == 0 else f"A Study of Caches    {n}", OWN[n][0], *PROSE, OWN[n][1]])) for n in range(1, 7)]
    got = cases(make(spark, pages, [("p", "A Study of Caches", ["A. Smith", "B. Li"])]))
    assert got == {(f"g{n}", 0, k) for n in range(1, 7) for k in ("page_number", "running_header")}


def test_words_go_on_over_pages_and_runs_of_numbers(spark):
    pages = [("a", "p", 1, "\n".join([*PROSE * 3, "The statis-"])), ("b", "p", 2, "\n".join(["tical model explains the vari-", "0.51", "12  14", "ance of it.", *PROSE * 3]))]
    repair = make(spark, pages)
    assert cases(repair) == {("a", 12, "broken_word"), ("b", 0, "broken_word")}
    assert any("The statistical model explains the variance of it." in r.text for r in repair.paragraphs().collect())


def test_corrections_are_applied(spark):
    text = {r.text for r in make(spark, [("a", "p", 1, "\n".join([*PROSE * 12, "", "Each CLASSIFIER explains rnodern sarnples."]))]).paragraphs().collect()}
    assert "Each CLASSIFIER explains modern samples." in text


def test_paragraphs_go_on_over_rows_and_hyphens():
    lines = ["Methods", "We found a high-", "frequency part of the", "0.5  0.7", "", "model in pre-", "and post-processing. It was", "12", "Every query was fast.", "", "next time"]
    assert [p for p, _ in S._paragraphs(lines, set(), set(), {})] == ["Methods", "0.5  0.7", "We found a high-frequency part of the model in pre- and post-processing. It was", "12", "Every query was fast.", "next time"]
    assert S._paragraphs(["a distri-", "3", "buted x-"], set(), {0, 2}, {"distributed": "shared"}) == [("3", False), ("a shared x", True)]
    assert S._paragraphs(["1", "", "2"], {2}, set(), {}) == [("1", False)]


@pytest.mark.parametrize("pages", [[], [("a", "p", 1, None)], [("a", "p", 1, ""), ("b", "p", 2, " \n\n"), ("b", "p", 2, " \n\n"), (None, "p", 3, "x")], [("a", None, None, "word " * 30_000)], [("a", "p", 1, "x" * 200_000 + "-\n" + "y" * 10)]])
def test_edges(spark, pages):
    repair = make(spark, pages)
    assert cases(repair) <= {("a", 0, "broken_word")}
    repair.paragraphs().collect()


@pytest.mark.parametrize(("line", "want"), [("[l2]", ("bracket", 12)), ("xiv", ("plain roman", 14)), ("Page 3 of 9", ("page", 3)), ("p. 7", ("p", 7)), ("— 8 —", ("dash", 8)), ("7O7", ("plain", 707)), ("12    Li et al.", ("beside", 12)), ("[lO]", ("bracket", 10)), ("l", ("plain", 1))])
def test_printed_numbers(line, want):
    assert want in [x[:2] for x in S.printed_numbers(line)]


@pytest.mark.parametrize("line", ["xyzi", "Vol. 7", "word", "", "LETTERS · Vol. 7"])
def test_other_lines(line):
    assert S.printed_numbers(line) == []


def test_anagram_differences():
    assert S.anagram("mernbrane") - S.anagram("rn") + S.anagram("m") == S.anagram("membrane")


def test_anagrams_and_variants_in_sql(spark):
    rows = [("mernbrane", "m", "rn", ["membrane"]), ("aa", "b", "a", ["ba", "ab"]), ("ström†\U0001f600", "t", "†", ["strömt\U0001f600"]), ("x", "y", "z", [])]
    got = spark.createDataFrame(rows, "w string, t string, s string, want array<string>").select("w", S.anagram_of(F.col("w")).alias("h"), S._variants(F.col("w"), F.col("t"), F.col("s")).alias("v"), "want").collect()
    assert all(r.h == S.anagram(r.w) and r.v == r.want for r in got)


def test_a_volume_is_known_by_its_other_papers(spark):
    line = "Archive of Open Sorting"
    pages = [(f"p{k}", f"q{k}", 1, "\n".join([*([line] if k < 2 else []), OWN[k][0], *PROSE, OWN[k][1]])) for k in range(3)]
    assert cases(make(spark, pages)) == {("p0", 0, "running_header"), ("p1", 0, "running_header")}


def test_pages_without_a_paper_are_apart(spark):
    pages = [(f"n{k}", None, 1, "\n".join([OWN[k][0], *PROSE, "The end of it."])) for k in range(2)]
    repair = make(spark, pages)
    assert {r.paper_id for r in repair.paragraphs().collect()} == {None}


def volume(n):
    """A volume of ``n`` pages whose running line changes every two pages, the second one misread; one of more than 150 letters; prose at the other edge."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(4, 9)))
    title = [" ".join(word() for _ in range(30 if i == 3 else 1 if i == 4 else 5)) for i in range(n // 2)]
    misread = [t[:1] + ("x" if t[1] != "x" else "y") + t[2:] for t in title]
    return [(f"v{k}", "v", k, "\n".join([(misread if k % 2 else title)[k // 2], *(" ".join(word() for _ in range(9)) + "." for _ in range(4))])) for k in range(n)]


@pytest.mark.parametrize("paired", [S.PAIRED_PAGES, 0, 1000])
def test_running_lines_that_change_within_a_long_volume(spark, monkeypatch, paired):
    monkeypatch.setattr(S, "PAIRED_PAGES", paired)
    got = cases(make(spark, volume(64)))
    assert {x for x in got if x[2] == "running_header"} == {(f"v{k}", 0, "running_header") for k in range(64)}
