import pytest

from evispark.llm import mixing as M

SIZED = "doc_id bigint, source string, n_tokens bigint, mix_id string"
TARGETS = "mix_id string, source string, target_weight double, max_repeats int, note string"


def sized(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SIZED)


def targets(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], TARGETS)


def test_shares_are_reached_and_caps_hold(spark):
    docs = sized(spark, [(i, "big", 10 + i % 7) for i in range(600)] + [(1000 + i, "small", 5) for i in range(20)] + [(5000, None, 9), (5001, "big", 0)])
    t = targets(spark, [("m", "big", 3.0, 1), ("m", "small", 1.0, 4), ("m", "gone", 2.0, 1), ("m", "off", 0.0, 1), ("n", "small", 1.0, None)])
    rows = M.mix_sources(docs, t).collect()
    m = [r for r in rows if r.mix_id == "m"]
    used = {s: sum(r.n_tokens for r in m if r.source == s) for s in ("big", "small")}
    assert used["small"] == 400 and 1200 - 17 <= used["big"] <= 1200
    assert max(r.repeat_no for r in m if r.source == "small") == 4 and max(r.repeat_no for r in m if r.source == "big") == 1
    assert len({(r.mix_id, r.doc_id, r.repeat_no) for r in rows}) == len(rows) and all(r.n_tokens for r in rows)
    assert [r.virtual_finish for r in m] == sorted(r.virtual_finish for r in m)
    assert sum(r.n_tokens for r in rows if r.mix_id == "n") == 100
    shares = {(r.mix_id, r.source): r for r in M.mix_shares(docs, t).collect()}
    assert shares["m", "gone"].n_tokens == 0 and shares["m", "off"].n_copies == 0 and abs(shares["m", "small"].reached_share - 0.25) < 0.01


def test_a_prefix_of_the_order_is_balanced(spark):
    docs = sized(spark, [(i, "a", 3) for i in range(500)] + [(1000 + i, "b", 7) for i in range(500)])
    rows = M.mix_sources(docs, targets(spark, [("m", "a", 1.0, 1), ("m", "b", 2.0, 1)]), bucket_rows=250).collect()
    for n in (50, 200, len(rows)):
        a = sum(r.n_tokens for r in rows[:n] if r.source == "a")
        assert abs(a / sum(r.n_tokens for r in rows[:n]) - 1 / 3) < 0.05


@pytest.mark.parametrize(("budget", "want"), [(90, (30, 60)), (10_000, (200, 100)), (200, (100, 100)), (7, (2, 5))])
def test_budget(spark, budget, want):
    docs = sized(spark, [(i, "a", 1) for i in range(200)] + [(1000 + i, "b", 1) for i in range(100)])
    t = targets(spark, [("m", "a", 1.0, 1), ("m", "b", 2.0, 1)])
    rows = M.mix_sources(docs, t, budget).collect()
    got = tuple(sum(r.n_tokens for r in rows if r.source == s) for s in "ab")
    assert sum(got) == min(budget, 300) and all(abs(x - y) <= 1 for x, y in zip(got, want, strict=True))


def test_the_merge_is_cut_at_the_total(spark):
    docs = sized(spark, [(i, "abc"[i % 3], 1 + i * 37 % 50) for i in range(900)])
    t = targets(spark, [("m", "a", 1.0, 2), ("m", "b", 2.0, None), ("m", "c", 5.0, 3), ("n", "a", 1.0, 1)])
    everything = M.mix_sources(docs, t, 5000).collect()
    for budget in (100, 3000, 40_000):
        rows = [(r.mix_id, r.doc_id, r.repeat_no) for r in M.mix_sources(docs, t, budget).collect()]
        want, sums = [], {}
        for r in everything if budget < 3001 else ():
            sums[r.mix_id] = sums.get(r.mix_id, 0) + r.n_tokens
            if sums[r.mix_id] <= budget:
                want.append((r.mix_id, r.doc_id, r.repeat_no))
        assert rows == want or budget > 3000
        got = M.mix_checks(docs, t, budget).collect()
        assert {r.mix_id for r in got} == {"m", "n"} and all(r.within_caps and r.within_total and r.in_order for r in got)


def test_many_repeats_are_made_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "REPEAT_BLOCK", 4)
    rows = M.mix_sources(sized(spark, [(1, "b", 1), (2, "a", 30)]), targets(spark, [("m", "b", 1.0, None), ("m", "a", 1.0, 1)])).collect()
    assert sorted(r.repeat_no for r in rows if r.source == "b") == list(range(1, 31))


def test_nulls_ties_and_nothing(spark):
    t = targets(spark, [("m", "a", None, 1), ("m", "b", 1.0, 2), ("m", "b", 1.0, 3), (None, "b", 1.0, 1), ("m", None, 1.0, 1), ("k", "b", 1.0, 0)])
    rows = M.mix_sources(sized(spark, [(1, "b", 5), (2, "b", 5), (2, "b", 5)]), t).collect()
    assert {r.mix_id for r in rows} == {"m"} and sum(r.n_tokens for r in rows) == 45
    assert M.mix_sources(sized(spark, []), t).count() == 0 and M.mix_shares(sized(spark, []), t).count() == 3
    assert M.mix_sources(sized(spark, [(1, "b", 5)]), targets(spark, [])).count() == 0


def test_sizes_are_tokens(spark):
    docs = spark.createDataFrame([(1, "one two", "a", 9), (2, None, "a", 9), (3, "x", "b", 9), (4, "x", None, 9), (5, "", "a", 9)], "doc_id bigint, text string, source string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in M.sized_documents(docs, targets(spark, [("m", "a", 1.0, 1)])).collect()}
    assert got == {1: 2, 2: 0, 5: 0}
