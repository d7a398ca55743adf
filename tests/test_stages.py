import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evispark.functions import encoding as C
from evispark.functions.ids import call_key, claim_ids, stable_id
from evispark.operators import judging as J
from evispark.operators import stages as S
from evispark.operators import trajectories as T

CLAIM = "claim_id string, chunk_id string, claim_text string, page int, start_char int, end_char int"
CHUNK = "chunk_id string, paper_id string, text string, start_char int, end_char int, page_start int, page_end int"


def test_claims_against_chunks_and_spans(spark):
    page = "The model works well. It fails on noise."
    claims = spark.createDataFrame([("a", "k", "The model works well.", 1, 0, 21), ("b", "k", "Noise", 1, 31, 99), ("c", "k", "unrelated", 1, 5, 5), ("d", "gone", "x", 1, 0, 1), ("e", "k", None, 9, 0, 3)], CLAIM)
    chunks = spark.createDataFrame([("k", "p", page, 0, len(page), 1, 1)], CHUNK)
    pages = spark.createDataFrame([("p", 1, page)], "paper_id string, page_number int, text string")
    got = {r.claim_id: r for r in S.claim_metrics(claims, chunks, pages).collect()}
    assert set(got) == set("abce")
    assert (got["a"].location_valid, got["a"].span_match, got["a"].verbatim, got["a"].lexical_coverage) == (True, True, True, 1.0)
    assert (got["b"].location_valid, got["b"].verbatim, got["b"].span_text) == (False, True, "on noise.")
    assert (got["c"].span_text, got["c"].span_similarity, got["c"].span_match) == ("", 0.0, False)
    assert (got["e"].location_valid, got["e"].lexical_coverage) == (False, 0.0)
    cases = S.chunk_cases(chunks, claims, S.claim_metrics(claims, chunks, pages), spark.createDataFrame([("k", "exact"), ("k", None)], "chunk_id string, how string"))
    assert tuple(cases.first()) == ("k", 4, 1, False, True)
    assert [r.claim_id for r in S.worst_locations(S.claim_metrics(claims, chunks, pages), 2).collect()] == ["c", "e"]


def test_gold_claims_match_both_ways(spark):
    text = "Alpha beta gamma delta. Some other sentence about graphs. The last one is here."
    chunks = spark.createDataFrame([("k", text), ("empty", "")], "chunk_id string, text string")
    kind = "chunk_id string, claim_id string, text string, claim_type string"
    gold = spark.createDataFrame([("k", "g1", "alpha  beta gamma delta.", "finding"), ("k", "g2", "The last one is here.", "method"), ("k", "g3", "not there", "method"), ("empty", "g4", "x", "method")], kind)
    predicted = spark.createDataFrame([("k", "p1", "Alpha beta gamma delta", "finding"), ("k", "p2", "Some other sentence of graphs.", "finding"), ("k", "p3", "The last one is here.", "dataset"), ("k", "p4", "quite different words", "method"), ("k", "p5", None, None)], kind)
    got = {r.chunk_id: tuple(r)[1:] for r in S.gold_claim_cases(gold, predicted, chunks).collect()}
    assert got == {"k": (3, 5, 2, 2, 2, 1), "empty": (1, 0, 0, 0, 0, 0)}
    row = S.gold_claim_summary(S.gold_claim_cases(gold, predicted, chunks)).first()
    assert (row.gold_recall, row.gold_precision, row.gold_f1, row.gold_type_agreement) == (0.5, 0.4, 0.444, 0.5)


@pytest.mark.parametrize(("claim", "text", "span"), [("graphs are useful tools", "we say graphs are useful tools", (7, 30)), ("graphs are really useful tools", "graphs are useful tools indeed", (0, 23)), ("nothing alike at all", "some words", (None, None)), ("", "x", (None, None)), ("short", "a short one", (None, None))])
def test_located_claims(spark, claim, text, span):
    r = S.locate_claims(spark.createDataFrame([(claim, text)], "a string, b string"), "a", "b").first()
    assert (r.s, r.e) == span


def test_headings_are_placed_by_their_lines(spark):
    lines = spark.createDataFrame([("p", 1, 0, "x"), ("p", 1, 2, " Intro "), ("p", 1, 9, "Intro")], "paper_id string, page_number int, start_char int, line string")
    heads = spark.createDataFrame([("p", 1, "Intro"), ("p", 1, "Gone"), ("q", 1, "Intro")], "paper_id string, page_number int, heading string")
    assert {(r.paper_id, r.heading): r.start_char for r in S.locate_lines(heads, lines).collect()} == {("p", "Intro"): 2, ("p", "Gone"): 0, ("q", "Intro"): 0}


def test_verdicts_follow_numbers(spark):
    items = spark.createDataFrame([("b", 1), ("b", 2), ("b", 3)], "g string, number int")
    answers = spark.createDataFrame([("b", 0, 2, "x"), ("b", 1, 1, "y"), ("b", 2, 2, "z"), ("b", 3, 9, "w")], "g string, pos int, number int, verdict string")
    assert {r.number: r.verdict for r in J.align_verdicts(items, answers, ["g"]).collect()} == {1: "y", 2: "z", 3: None}


def test_arrays_of_unlike_length_are_an_error(spark):
    a, b = spark.createDataFrame([("k", [1, 2])], "k string, a array<int>"), spark.createDataFrame([("k", [3, 4])], "k string, b array<int>")
    assert sorted(tuple(r) for r in J.zip_strict(a, b, "k", "a", "b").collect()) == [("k", 0, 1, 3), ("k", 1, 2, 4)]
    with pytest.raises(Exception, match="unlike lengths of k"):
        J.zip_strict(a, spark.createDataFrame([("k", [3])], "k string, b array<int>"), "k", "a", "b").collect()


def test_agreement(spark):
    rows = spark.createDataFrame([("yes", "yes", "real"), ("no", "partial", "real"), ("no", "no", "made"), ("no", "yes", "made"), ("yes", None, "real")], "label string, predicted string, origin string")
    assert tuple(J.agreement(rows, "yes").first()) == (4, 1, 0.5, 0.75, 0.5, 0.5)
    assert tuple(J.agreement(rows.limit(0), "yes").first())[2:] == (None, None, None, None)


def test_unsupported_statements(spark):
    row = spark.sql("select array(struct('a' as statement, true as supported), struct('b' as statement, false as supported)) as c")
    assert row.select(J.unsupported_statements(F.col("c")).alias("r")).first()["r"] == ["b"]


MESSAGE = "case_id string, position int, kind string, tool_name string, content string, args string, claim_ids array<string>, synthesis_ids array<string>, synthesis_type string, items array<struct<title:string,text:string>>"
A, B = "0000000a-0000-0000-0000-000000000000", "0000000b-0000-0000-0000-000000000000"


def test_trajectories(spark):
    def call(case, pos, tool, ids=None, typed=None):
        return (case, pos, "call", tool, None, "{}", None, ids, typed, None)

    def back(case, pos, tool, content, items=None):
        return (case, pos, "return", tool, content, None, None, None, None, items)

    messages = spark.createDataFrame(
        [
            call("good", 1, "find"), back("good", 2, "find", A, [("Caches", None)]), call("good", 3, "draft", [A]),
            call("made up", 1, "draft", [B]), back("made up", 2, "draft", B), call("made up", 3, "find"),
            call("typed", 1, "find"), call("typed", 2, "generate_new_syntheses", None, "gap"), call("typed", 3, "find"), call("typed", 4, "find"),
        ],
        MESSAGE,
    )
    case = "case_id string, must_call array<string>, must_not_call array<string>, `order` array<array<string>>, synthesis_type string, max_tool_calls int"
    cases = spark.createDataFrame([(c, ["find"], ["drop"], [["find", "draft"]], "theme", 3) for c in ("good", "made up", "typed")] + [("silent", None, None, None, None, 0)], case)
    outputs = spark.createDataFrame([("good", "The result is on CACHES."), ("made up", "Done."), ("typed", "Done.")], "case_id string, output string")
    got = {r.case_id: (r.n_tool_calls, r.failed, r.passed, r.reports) for r in T.trajectory_cases(cases, messages, outputs).collect()}
    assert got["good"] == (2, [], True, True) and got["silent"] == (0, [], True, True)
    assert got["made up"] == (2, ["find before draft", "no invented ids"], False, False)
    assert got["typed"] == (4, ["at most 3 tool calls", "synthesis_type theme"], False, True)
    row = T.agent_summary(T.trajectory_cases(cases, messages, outputs)).first()
    assert (row.cases, row.pass_rate, row.invented_id_rate) == (4, 0.5, 0.25)


def test_keys_are_those_of_canonical_json(spark):
    texts = ["plain", "", 'quo"te\\ and\nbreak\t\r\f\b', "é ﬁ \U0001f600 \x7f\x00", "ends\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.json_text("t").alias("j"), call_key(F.lit("m"), F.lit("Claims"), F.lit("v1"), F.lit(0.1), F.lit("do"), F.col("t")).alias("k")).collect()
    assert all(r.j == json.dumps(r.t) for r in rows)
    want = lambda t: hashlib.sha256(json.dumps({"model": "m", "text_format": "Claims", "prompt_version": "v1", "temperature": 0.1, "instructions": "do", "input_text": t}, sort_keys=True).encode()).hexdigest()
    assert all(r.k == want(r.t) for r in rows)
    assert spark.createDataFrame([(None,)], "t string").select(C.json_text("t").alias("j")).first()["j"] == "null"


def test_vectors_round_trip(spark):
    rows = spark.createDataFrame([([0.5, -2.0],), (None,)], "v array<double>").select(C.encode_vector("v").alias("e"))
    got = rows.select("e", C.decode_vector("e").alias("v")).collect()
    assert [(r.e, r.v) for r in got] == [("ADgAwA==", [0.5, -2.0]), (None, None)]
    bad = spark.createDataFrame([("",), ("A",), ("AAAA AAA",), ("AAAA",), ("fH8=",)], "e string").select(C.decode_vector("e").alias("v"))
    assert [r.v for r in bad.collect()] == [None] * 5


def test_claims_of_a_chunk_have_ids_by_place(spark):
    r = spark.createDataFrame([("k", ["a", "b"]), ("e", [])], "k string, c array<string>").select("k", claim_ids(F.col("k"), F.col("c")).alias("ids"), stable_id("claim", F.concat("k", F.lit(":1"))).alias("one")).collect()
    assert r[0].ids[1] == r[0].one and len(r[0].ids) == 2 and r[1].ids == []
