import pytest
from pyspark.sql import functions as F

from evispark.operators import persistence as S
from evispark.sources import gold as G


def test_one_bad_claim_loses_its_chunk(spark):
    chunks = spark.createDataFrame([("k", "right", 0, 100, 1, 1), ("l", "p", 0, 100, 1, 1)], "chunk_id string, paper_id string, start_char int, end_char int, page_start int, page_end int")
    claims = spark.createDataFrame([("a", "k", "wrong", 1, 5, 10), ("b", "l", "p", 1, 5, 10), ("c", "l", "p", 1, 5, 101), ("d", "none", "p", 1, 5, 10), ("e", None, "p", 1, 1, 2)], "claim_id string, chunk_id string, paper_id string, page int, start_char int, end_char int")
    assert [(r.claim_id, r.paper_id) for r in S.accepted_claims(claims, chunks).collect()] == [("a", "right")]


def test_counts_of_answers_are_ignored(spark):
    claims = spark.createDataFrame([("a", "p"), ("b", "p")], "claim_id string, paper_id string")
    syn = spark.createDataFrame([("s", ["a", "b", "x"], 9, 9), ("t", ["x"], 1, 1)], "synthesis_id string, supporting_claim_ids array<string>, supporting_papers int, supporting_claims int")
    rows, made = S.stored_syntheses(syn, claims)
    assert {r.synthesis_id: (r.supporting_papers, r.supporting_claims) for r in rows.collect()} == {"s": (1, 2), "t": (0, 0)}
    assert sorted(tuple(r) for r in made.collect()) == [("s", "a"), ("s", "b")]


def test_labels_of_papers(spark):
    got = [r.l for r in spark.range(1, 29).select(S.paper_label(F.col("id")).alias("l")).collect()]
    assert (got[0], got[25], got[26]) == ("A", "Z", "P27")


def test_batches(spark):
    rows = spark.range(30).select(F.lit("g").alias("g"), "id")
    assert [r.n for r in S.batches(rows, "g", ["id"]).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [12, 12, 6]


@pytest.mark.parametrize(("body", "message"), [('{"error": {"message": "m"}}', "m"), ('{"message": "n"}', "n"), ("{}", None), ("no", None), (None, None)])
def test_error_messages(spark, body, message):
    assert spark.createDataFrame([(body,)], "b string").select(S.error_message("b").alias("m")).first()["m"] == message


@pytest.mark.parametrize(
    ("line", "better"),
    [("- [1] Unknown authors. (n.d.). Smith and Li-2019-Deep things.", "- [1] Smith, Li. (2019). Deep things."), ("[2] Unknown authors. (n.d.). scan.", "[2] Unknown authors. (n.d.). scan."), ("[3] A. (2001). T.", "[3] A. (2001). T.")],
)
def test_unknown_references(spark, line, better):
    assert spark.createDataFrame([(line,)], "t string").select(S.improved_reference(F.col("t")).alias("r")).first()["r"] == better


def test_gold(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"id": "x", "topic": "t"}]')
    assert G.read_scenarios(spark, f"{tmp_path}/s.json").first()["max_claims"] == 60
    (tmp_path / "a.json").write_text('[{"id": "x", "order": [["a", "b"]]}]')
    case = G.read_agent_cases(spark, f"{tmp_path}/a.json").first()
    assert (case.must_call, case.order, case.max_tool_calls) == ([], [["a", "b"]], 8)
    (tmp_path / "l.json").write_text('{"snapshot_fingerprint": "f", "chunks": {"k": [{"quote": "q", "claim_type": "odd"}], "z": []}}')
    labels = G.read_gold_claims(spark, f"{tmp_path}/l.json", "f")
    known = spark.createDataFrame([("k", "a q b")], "chunk_key string, text string")
    assert [tuple(r)[1:] for r in G.claim_problems(labels, known).collect()] == [("k", "unknown type")]
    assert [tuple(r)[1:] for r in G.claim_problems(labels, known.limit(0)).collect()] == [("k", "unknown chunk")]
    with pytest.raises(Exception, match="another snapshot"):
        G.read_gold_claims(spark, f"{tmp_path}/l.json", "other").collect()
