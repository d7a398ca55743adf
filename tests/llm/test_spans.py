import random

import pytest

from evispark.llm import spans as S

DOCS = "doc_id bigint, text string, h string, d int, start_char string"


def make(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in texts], DOCS)


def brute(texts, size=S.MIN_CHARS):
    where, out = {}, []
    docs = [(i, t) for i, t in texts if i is not None and t]
    for i, t in docs:
        for a in range(len(t) - size + 1):
            where.setdefault(t[a : a + size], set()).add(i)
    for i, t in dict(docs).items():
        hit = [a for a in range(len(t) - size + 1) if len(where[t[a : a + size]]) > 1]
        spans = []
        for a in hit:
            if spans and a <= spans[-1][1]:
                spans[-1][1] = a + size
            else:
                spans.append([a, a + size])
        out += [(i, a, b) for a, b in spans]
    return sorted(out)


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("al", "be", "字", "de", "😀") for b in ("pha", "ta", "mma", "é")]
    texts = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(5, 250)))
        if texts and rng.random() < 0.7:
            other = rng.choice(texts)[1]
            a = rng.randrange(len(other))
            part = other[a : a + rng.choice([150, 199, 200, 201, 260, 700])]
            at = rng.randrange(len(t))
            t = t[:at] + part + t[at:]
        texts.append((i, t))
    return texts


@pytest.mark.parametrize(("seed", "batches", "hot"), [(1, 1, 4096), (2, 2, 4096), (3, 3, 1), (4, 2, 0)])
def test_spans_are_all_and_exact(spark, seed, batches, hot):
    texts = corpus(seed) + [(900, None), (901, ""), (902, "short"), (None, "x" * 500), (903, "ab" * 300), (904, "z" + "ab" * 200), (905, "." * 700), (906, "q" + "." * 450 + "q")]
    texts += texts[:3]
    got = sorted(tuple(r) for r in S.shared_spans(make(spark, texts), batches=batches, hot_contexts=hot).collect())
    assert got == brute(texts) and len(got) > 10


def test_one_passage_in_most_documents(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(600))
    texts = [(i, "".join(rng.choice("ijklmnop ") for _ in range(150)) + passage + str(i) * 20) for i in range(60)]
    for hot in (4096, 10):
        assert sorted(tuple(r) for r in S.shared_spans(make(spark, texts), hot_contexts=hot).collect()) == brute(texts)


def test_nothing(spark):
    assert S.shared_spans(make(spark, [])).count() == 0
    assert S.shared_spans(make(spark, [(1, "a" * 999)])).count() == 0


def test_shares(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef ") for _ in range(400))
    docs = make(spark, [(1, text), (2, text[:250] + "q" * 50), (3, None), (4, "x")])
    got = {r.doc_id: (r.shared_chars, r.shared_share) for r in S.shared_shares(docs, S.shared_spans(docs)).collect()}
    assert got == {1: (250, 0.625), 2: (250, round(250 / 300, 9)), 3: (0, 0.0), 4: (0, 0.0)}


def test_runs_are_compacted(spark):
    texts = corpus(6, 12)
    index = S.SpanIndex(spark, max_runs=2)
    for k in range(5):
        index.append(S.anchors(make(spark, texts[k::5])))
    assert len(index.runs) <= 2 and sum(index.read(r).count() for r in index.runs) == S.anchors(make(spark, texts)).count()
    index.drop()


def test_very_long_text(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghij ") for _ in range(1_500_000))
    got = sorted(tuple(r) for r in S.shared_spans(make(spark, [(1, long), (2, "q" * 10 + long[700_000:700_900] + "q" * 10)])).collect())
    assert got == [(1, 700_000, 700_900), (2, 10, 910)]


def test_runs_are_not_exchanged(spark):
    texts = corpus(7, 12)
    index = S.SpanIndex(spark)
    index.append(S.anchors(make(spark, texts[:6])))
    fresh = index.append(S.anchors(make(spark, texts[6:])))
    joined = index.read(index.runs[0]).join(fresh.groupBy("h").count().select("h").hint("merge"), "h", "left_semi")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.drop()


def test_the_index_is_compacted_on_the_way(spark, monkeypatch):
    seen = []
    compact = S.SpanIndex.compact
    monkeypatch.setattr(S.SpanIndex, "compact", lambda self: (seen.append(len(self.runs)), compact(self)))
    texts = corpus(8)
    assert sorted(tuple(r) for r in S.shared_spans(make(spark, texts)).collect()) == brute(texts) and seen == [2]
    seen.clear()
    assert sorted(tuple(r) for r in S.shared_spans(make(spark, texts), batches=7, max_runs=3).collect()) == brute(texts) and seen == [3, 3]
