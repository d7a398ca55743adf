import random
import re

import numpy as np
import pytest

from evispark.llm import near as N

RECORDS = "field_name string, id string, text string, s string, n int"


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], RECORDS)


def brute(rows):
    sets = {}
    for f, i, t in rows:
        if i is not None and t:
            w = frozenset(re.findall("[a-z0-9]+", t.lower()))
            if len(w) >= 8:
                sets.setdefault((f, i), set()).add(w)
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for k, a in enumerate(keys) for b in keys[k + 1 :] if a[0] == b[0] and any(10 * len(x & y) >= 7 * len(x | y) for x in sets[a] for y in sets[b])}


def corpus(n=400, seed=1, sizes=(8, 40)):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(3000)]
    rows = []
    for i in range(n):
        if i % 3 == 0 or not rows:
            words = [rng.choice(vocabulary[:60] if rng.random() < 0.7 else vocabulary) for _ in range(rng.randint(*sizes))]
        else:
            words = rng.choice(rows)[2].split()
            for _ in range(rng.randint(0, max(1, len(words) // 4))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rng.shuffle(words)
        rows.append((rng.choice(["x", "x", "y"]), f"id{i:04d}", " ".join(words).title()))
    return rows


@pytest.mark.parametrize(("sizes", "tile"), [((8, 40), N.TILE), ((8, 40), 5), ((40, 160), N.TILE), ((60, 95), 7)])
def test_all_pairs_are_found(spark, sizes, tile):
    rows = corpus(sizes=sizes)
    got = {tuple(r) for r in N.alike_pairs(make(spark, rows), tile).collect()}
    want = brute(rows)
    assert len(want) > 50 and got == want


def test_a_crowd_of_copies_meets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 3)
    text = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [("f", f"c{k:02d}", text) for k in range(20)] + [("f", "d", text + " iota")]
    assert {tuple(r) for r in N.alike_pairs(make(spark, rows)).collect()} == brute(rows)


def test_no_task_sees_a_hot_shard_whole(spark):
    """Sets of common words only: with small tiles nearly all shards are hot, and no part holds more of one than a tile."""
    rows = [("f", f"id{k}", " ".join(f"w{j}" for j in random.Random(k).sample(range(14), 10))) for k in range(300)]
    sets = N.distinct_sets(N.word_sets(make(spark, rows)))
    common = N._common_words(sets, 20)
    hot = N._hot_shards(sets, spark.sparkContext.broadcast(common), 20)
    assert hot and min(hot.values()) >= 2
    keys, blocks = np.array(sorted(hot), dtype=np.uint64), np.array([hot[k] for k in sorted(hot)])
    found = [N._tiled(*x, keys, blocks)[3] for x in N._shard_keys(iter(sets.select("field_name", "sid", "n", "words").toArrow().to_batches()), common)]
    before = [x[3] for x in N._shard_keys(iter(sets.select("field_name", "sid", "n", "words").toArrow().to_batches()), common)]
    most = lambda ks: np.unique(np.concatenate(ks), return_counts=True)[1].max()
    assert most(found) < most(before) / 2
    assert {tuple(r) for r in N.alike_pairs(make(spark, rows), 20).collect()} == brute(rows)


def test_edges(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [("f", "b", text), ("f", "a", text.upper()), ("f", "a", text), ("g", "a", text), ("f", "c", None), ("f", "d", ""), ("f", "e", "too few words"), ("f", None, text), ("f", "z", text + " iota kappa lamda"), ("f", "y", text + " iota kappa lamda mu")]
    assert {tuple(r) for r in N.alike_pairs(make(spark, rows)).collect()} == brute(rows) == {("f", "a", "b"), ("f", "a", "z"), ("f", "b", "z"), ("f", "y", "z")}
    assert N.alike_pairs(make(spark, [])).count() == 0 and N.alike_groups(make(spark, [])).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"v{k}" for k in range(20_000))
    rows = [("f", "a", long), ("f", "b", long + " more"), ("f", "c", " ".join(f"v{k}" for k in range(13_000)))]
    assert {tuple(r) for r in N.alike_pairs(make(spark, rows)).collect()} == {("f", "a", "b")}


def test_groups(spark):
    rows = corpus(300, 5)
    want = brute(rows)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for f, a, b in want:
        parent[root((f, a))] = root((f, b))
    got = {(r.field_name, r.id): r for r in N.alike_groups(make(spark, rows)).collect()}
    assert all((root(a) == root(b)) == (got[a].group_id == got[b].group_id) for a in got for b in got if a[0] == b[0])
    assert sum(r.n_links for r in got.values()) == 2 * len(want)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.u: r.root for r in N.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert set(got[i] for i in range(201)) == {0} and set(got[i] for i in range(1000, 1050)) == {1000}


def test_vantage_point_tree_loses_nothing():
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.array([c ^ (np.uint64(1) << np.uint64(rng.integers(64))) for c in np.repeat(centres, 40)], dtype=np.uint64)
    n = np.sort(rng.integers(8, 30, fp.size)).astype(np.int64)
    lead = rng.random(fp.size) < 0.8
    got = {(min(a, b), max(a, b)) for i, j in N.vantage_pairs(n, lead, fp, leaf=32) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    i, j = np.triu_indices(fp.size, 1)
    ok = (np.bitwise_count(fp[i] ^ fp[j]) <= 3 * (n[i] + n[j]) // 17) & (7 * n[j] <= 10 * n[i]) & (lead[i] | ((n[i] == n[j]) & lead[j]))
    must = (np.bitwise_count(fp[i] ^ fp[j]) <= 3 * (n[i] + n[j]) // 17) & (7 * n[j] <= 10 * n[i]) & lead[i] & (lead[j] | (n[i] < n[j]))
    want, most = set(zip(i[must].tolist(), j[must].tolist(), strict=True)), set(zip(i[ok].tolist(), j[ok].tolist(), strict=True))
    assert want <= got <= most | want and len(want) > 100
