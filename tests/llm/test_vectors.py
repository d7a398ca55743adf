import base64

import numpy as np
import pytest

from evispark.llm import vectors as V

ROWS = "vec_id bigint, model string, embedding_f16_b64 string, vec string, h int"


def b64(x, breaks=False):
    s = base64.b64encode(np.asarray(x, dtype="<f2").tobytes()).decode()
    return "\n".join(s[i : i + 76] for i in range(0, len(s), 76)) if breaks else s


def make(spark, rows):
    return spark.createDataFrame([(i, m, v, "clash", 1) for i, m, v in rows], ROWS)


def brute(rows, k=10):
    out = set()
    for model, size in V.DIMENSIONS.items():
        seen = {}
        for i, m, v in rows:
            if m == model and i is not None and (raw := V.half_precision(v, size)):
                seen.setdefault(i, np.frombuffer(raw, "<f2").astype(np.float64))
        ids = sorted(seen)
        for a in ids:
            near = sorted((-float((seen[a] * seen[b]).sum() / (np.sqrt((seen[a] ** 2).sum()) * np.sqrt((seen[b] ** 2).sum()))), b) for b in ids if b != a)[:k]
            out |= {(min(a, b), max(a, b)) for c, b in near if -c >= 0.5}
    return out


def clusters(n, centres, size, seed=0, spread=0.8):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, size))
    x = c[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def found(spark, rows):
    return {tuple(r) for r in V.neighbour_pairs(V.nearest_vectors(make(spark, rows))).collect()}


def test_readable_values():
    good = b64(np.ones(768))
    assert V.half_precision(b64(np.ones(768), True), 768) == V.half_precision(good, 768) is not None
    for bad in (None, "", good[:-4], "é" + good[1:], good[:-1] + "*", b64(np.zeros(768)), b64(np.full(768, np.inf)), b64([np.nan] * 768), b64(np.ones(1536)), " " + good):
        assert V.half_precision(bad, 768) is None


def test_small_tables_are_exact(spark):
    x = clusters(120, 6, 768)
    rows = [(i, "vec-small-0", b64(x[i] * (1 + i % 3))) for i in range(120)]
    rows += [(200 + i, "vec-small-0", b64(x[7])) for i in range(20)] + [(300, "vec-base-1", b64(clusters(1, 1, 1536)[0])), (301, "other", b64(x[0])), (302, None, b64(x[0])), (None, "vec-small-0", b64(x[0])), (303, "vec-small-0", None), (304, "vec-small-0", "x")]
    rows += rows[:10] + rows[3:4] * 30
    assert found(spark, rows) == brute(rows)


def test_nothing(spark):
    assert found(spark, []) == set() and found(spark, [(1, "vec-base-1", "x")]) == set()


@pytest.mark.parametrize("block", [V.BLOCK_ROWS, 60])
def test_tree_recall(spark, monkeypatch, block):
    monkeypatch.setattr(V, "LEAF_ROWS", 64)
    monkeypatch.setattr(V, "SAMPLE_ROWS", 300)
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    x = clusters(700, 25, 768, 3, 0.6)
    rows = [(i, "vec-small-0", b64(v)) for i, v in enumerate(x)]
    want, got = brute(rows), found(spark, rows)
    assert len(want & got) / len(want) >= 0.95 and len(got - want) <= 0.05 * len(want)


def test_many_copies_of_one_vector(spark):
    x = clusters(30, 3, 768)
    rows = [(i, "vec-small-0", b64(x[0])) for i in range(60)] + [(100 + i, "vec-small-0", b64(v)) for i, v in enumerate(x)]
    got = {(r.vec_id, r.other) for r in V.nearest_vectors(make(spark, rows)).collect()}
    assert {o for v, o in got if v == 59} == set(range(10)) and {o for v, o in got if v == 3} == set(range(11)) - {3}


def test_no_or_few_pairs_prove_no_recall():
    x = V._matrix([v.astype("<f2").tobytes() for v in np.random.default_rng(0).normal(size=(400, 768))])
    tree = V.Tree(x, 50)
    none = np.zeros(0, dtype=int)
    assert tree.n_leaves > 4 and V.enough_visits(tree, x[:100], none, none) == tree.n_leaves
    home = tree.visits(x[:100], 1)[:, 0]
    assert V.enough_visits(tree, x[:100], np.arange(3), home[:3]) == tree.n_leaves
    assert V.enough_visits(tree, x[:100], np.repeat(np.arange(100), 10), np.repeat(home, 10)) == 1


def test_copies_dont_hide_lost_neighbours(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAF_ROWS", 64)
    monkeypatch.setattr(V, "SAMPLE_ROWS", 300)
    x = clusters(500, 12, 768, 3, 0.95)
    rows = [(i, "vec-small-0", b64(v)) for i, v in enumerate(x)] + [(1000 + i, "vec-small-0", b64(x[0])) for i in range(1000)]
    true = {p for p in brute(rows[:500]) if 0 not in p}
    got = found(spark, rows)
    assert len(true & got) / len(true) >= 0.98


def test_true_neighbours_are_of_all_vectors_and_of_other_directions(spark):
    x = clusters(300, 10, 768, 5, 0.6)
    rows = [(i, "vec-small-0", b64(v)) for i, v in enumerate(x)] + [(900 + i, "vec-small-0", b64(x[i % 20])) for i in range(100)]
    vectors = V.readable_vectors(make(spark, rows)).repartition(3)
    hashes = {r.vec_id: r.h for r in vectors.select("vec_id", "h").collect()}
    unit = V._matrix([np.asarray(v, "<f2").tobytes() for v in x])
    got = V.true_neighbours(vectors, {"vec-small-0": (V.Tree(unit, 40), unit[:50], np.array([hashes[i] for i in range(50)]))}, 10).collect()
    near = unit[:50] @ unit.T
    np.fill_diagonal(near, -2)
    want = {(q, hashes[o]) for q in range(50) for o in np.argsort(-near[q])[:10] if near[q, o] >= 0.5}
    assert {(r["query"], r.h) for r in got} == want and len(got) == len(want) > 300
