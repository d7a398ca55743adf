import pytest
from pyspark.sql import functions as F

from evispark.operators import evaluation as E
from evispark.operators.alignment import align_sentences
from evispark.operators.retrieval import mean_metrics, ranking_metrics


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q", r, r in (2, 4)) for r in range(1, 9)] + [("e", 1, False)], "q_id string, rank int, relevant boolean")
    relevant = spark.createDataFrame([("q", 4), ("e", 0), ("n", 2)], "q_id string, n_relevant int")
    got = {r.q_id: r for r in ranking_metrics(ranked, relevant).collect()}
    assert (got["q"].precision_5, got["q"].recall_10, got["q"].mrr) == (0.4, 0.5, 0.5)
    assert got["e"].mrr is None and got["n"].mrr == 0.0
    assert mean_metrics(ranking_metrics(ranked, relevant)).first()["queries"] == 2


@pytest.mark.parametrize(("pairs", "kappa"), [([("a", "a"), ("b", "b")], 1.0), ([("a", "b"), ("b", "a")], -1.0), ([("a", "a")], None)])
def test_kappa(spark, pairs, kappa):
    m = E.confusion_matrix(spark.createDataFrame(pairs, "l string, p string"), "l", "p")
    assert E.cohen_kappa(m).first()["kappa"] == kappa


@pytest.mark.parametrize(("checks", "verdict"), [([True, True], "supported"), ([False], "unsupported"), ([], "unsupported"), (None, "unsupported"), ([True, False], "partial")])
def test_verdicts(spark, checks, verdict):
    assert spark.createDataFrame([(checks,)], "c array<boolean>").select(E.support_verdict(F.col("c")).alias("v")).first()["v"] == verdict


@pytest.mark.parametrize(("bad", "n", "verdict"), [(0, 0, "unfaithful"), (0, 3, "faithful"), (1, 3, "partial"), (2, 4, "unfaithful")])
def test_faithfulness(spark, bad, n, verdict):
    assert spark.range(1).select(E.faithfulness(F.lit(bad), F.lit(n)).alias("v")).first()["v"] == verdict


def test_comparison(spark):
    kind = "metric string, value double"
    now = spark.createDataFrame([("m/a", 0.5), ("m/b", 0.9), ("m/c", 0.7), ("m/d", 1.0), ("m/x", 0.0), ("m/n", 1.0)], kind)
    base = spark.createDataFrame([("m/a", 0.9), ("m/b", 0.5), ("m/c", 0.71), ("m/d", None), ("m/x", 1.0), ("m/g", 1.0)], kind)
    got = {r.metric: r.status for r in E.compare_metrics(now, base, {k: "up" for k in "abcdng"}, 0.02).collect()}
    assert got == {"m/a": "regressed", "m/b": "improved", "m/c": "ok", "m/d": "ok", "m/n": "new", "m/g": "missing"}


def test_settings_and_gated_metrics(spark):
    a, b = (spark.createDataFrame(x, "key string, value string") for x in ([("seed", "0"), ("n_chunks", "5"), ("other", "x")], [("seed", "0"), ("n_chunks", "6"), ("models", "m")]))
    assert {tuple(r) for r in E.config_mismatches(a, b).collect()} == {("n_chunks", "5", "6"), ("models", None, "m")}
    rows = spark.createDataFrame([("m", "s", "up_rate", 0.5), ("m", "s", "latency_mean_s", 1.0), ("m", "s", "count", 3.0)], "model string, stage string, key string, value double")
    directions = spark.createDataFrame([("s", "up_rate", "up"), ("s", "latency_mean_s", "down")], "stage string, key string, better string")
    assert [tuple(r) for r in E.gated_metrics(rows, directions).collect()] == [("m/s/up_rate", 0.5, "up")]


def test_alignment(spark):
    s = spark.createDataFrame([("d", "1", "Alpha beta gamma."), ("d", "2", "Delta epsilon zeta eta theta."), ("d", "3", "Nothing alike"), ("e", "4", "Alpha beta gamma."), ("d", "5", None)], "k string, sentence_id string, sentence_text string")
    b = spark.createDataFrame([("d", "alpha  beta gamma."), ("d", "Delta epsilon zeta eta thetas.")], "k string, sentence string")
    got = {r.sentence_id: r.aligned for r in align_sentences(s, b, "k").collect()}
    assert got == {"1": True, "2": True, "3": False, "4": False, "5": False}


def test_usage_cost_is_null_if_any_is(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 2.0, 4.0), ("b", 1, None, 1.0), ("b", 1, 1.0, None)], "m string, t int, c double, l double")
    got = {r.m: (r.calls, r.tokens, r.cost, r.latency_mean) for r in E.usage(rows, "m", "t", "c", "l").collect()}
    assert got == {"a": (2, 3, 3.0, 3.0), "b": (2, 2, None, 1.0)}
