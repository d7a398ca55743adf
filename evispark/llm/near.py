"""Alike records: texts whose word sets have a Jaccard similarity of at least 0.7, without loss.

Records with the same word set are one representative. A representative's fingerprint is 64 bits, the parity of
its words per bit; two sets that differ in k words have fingerprints at a Hamming distance of at most k,
and a similarity of 0.7 or more leaves at most 3/17 of the two sizes as difference. So the search is a ball query in Hamming
space, and the ball is exact: nothing alike lies outside.

Shards come from the words themselves: in a common order (rare words first) alike sets share two words early
on; a set goes to the shards of the pairs of common words, and of the single rare words, there. A shard is ordered by the distance
to the empty set, which is the set's size, and compared within the bounds that this gives; one of more than
LEAF rows is searched by a vantage-point tree: a node divides its fingerprints by their distance to a vantage point, at the distance
that leaves the least work; the triangle inequality drops what lies farther than the ball reaches, and only sets whose ball crosses the boundary
are compared on both sides. Every candidate is then confirmed on the words.

Shards that could be too large are known before anything is moved: only pairs of words that are both in more than TILE sets can have them, so these pairs
alone are counted; a shard above TILE rows goes out as tiles, pairs of its blocks, and no task ever sees it whole.

One tree over all fingerprints prunes nothing here: distances between unlike texts concentrate around one value, and
the ball is wider than their spread. That is why shards come first.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.staging import broadcast_if_small, shuffle_partitions, stage

MIN_WORDS = 8
#: Sets whose smaller partner has more words than this are sharded by single words.
PAIR_WORDS = 64
#: A word in more than this share of all sets is common; at most (mean set size / share) words can be.
COMMON_SHARE = 0.001
MAX_COMMON = 200_000
#: Shards with more rows than this are cut into tiles.
TILE = 20_000
#: Shards and nodes of up to so many rows are compared in order of size, others by a tree.
LEAF = 2048
#: The copies of one word set meet in blocks of this many.
COPIES = 2048
#: A part, the shards of one task, has the keys of about as many sets.
SETS_PER_PART = 40_000
_WORD = re.compile("[a-z0-9]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def word_sets(records: DataFrame) -> DataFrame:
    """(field_name, id, s, n, words) of (field_name, id, text): the set as sorted words, its hash and size.

    Null texts, and texts with fewer than 8 different words, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, s, n, words = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = set(_WORD.findall(text.lower())) if text else ()
                if len(found) >= MIN_WORDS:
                    joined = " ".join(sorted(found))
                    keep.append(i), n.append(len(found)), words.append(joined), s.append(_hash(joined))
            at = pa.array(keep, pa.int32())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.array(s, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(words, pa.string())], names=["field_name", "id", "s", "n", "words"])

    return records.select("field_name", "id", "text").filter("id is not null").mapInArrow(run, "field_name string, id string, s bigint, n int, words string")


def _common_words(sets: DataFrame, tile: int = TILE) -> dict[str, int]:
    """word -> number of sets, for the words in more than COMMON_SHARE of all sets, or in more than ``tile``: a bounded number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for words in batch.column(0).to_pylist():
                seen.update(words.split(" "))
            if len(seen) > 200_000:
                yield out()
        yield out()

    least = min(int(sets.count() * COMMON_SHARE), tile)  # of very many, the most frequent MAX_COMMON: the rest count as rare, which only makes their shards larger
    rows = sets.select("words").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") > least).orderBy(F.col("n").desc(), "word").limit(MAX_COMMON).collect()
    return {r["word"]: r["n"] for r in rows}


def prefix_lengths(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(as the larger, as the smaller partner): so many first words of a set of n words suffice to meet in one word."""
    return n - -(-7 * n // 10) + 1, n - -(-14 * n // 17) + 1


class _Words(dict):
    """word -> number; the arrays hold its hash, its place in the common order and whether it is common."""

    def __init__(self, common: dict[str, int]) -> None:
        super().__init__()
        self.common, self.hashes, self.ranks, self.often = common, [], [], []

    def __missing__(self, word: str) -> int:
        h, often = _hash(word), word in self.common
        self.hashes.append(h), self.often.append(often)
        self.ranks.append((1 << 62) + (self.common[word] << 20) + (h & 0xFFFFF) if often else h >> 3)
        self[word] = len(self)
        return self[word]


def _packed(parts: np.ndarray, sid: np.ndarray, n: np.ndarray, fp: np.ndarray, key: np.ndarray, lead: np.ndarray, who: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row (part, data) per part of the keys, named by ``parts``. A part's data lists each set once, with the keys it has there."""
    part = (key % np.uint64(parts.size)).astype(np.int64)
    order = np.lexsort((who, part))
    key, lead, who, part = key[order], lead[order], who[order], part[order]
    begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    names, data = [], []
    for a, b in zip(begins, [*begins[1:], part.size], strict=True):
        sets, count = np.unique(who[a:b], return_counts=True)
        short = ((key[a:b] >> np.uint64(25)) << np.uint64(1)) | lead[a:b].astype(np.uint64)
        head = np.array([sets.size, b - a], dtype="<i8").tobytes()
        names.append(int(parts[part[a]]))
        data.append(head + sid[sets].astype("<i8").tobytes() + fp[sets].astype("<u8").tobytes() + n[sets].astype("<i4").tobytes() + count.astype("<i4").tobytes() + short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
    yield pa.record_batch([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """(key, sid, n, lead, fp) of a row of :func:`_packed`."""
    sets, keys = np.frombuffer(data, dtype="<i8", count=2)
    at, cols = 16, []
    for kind in ("<i8", "<u8", "<i4", "<i4"):
        cols.append(np.frombuffer(data, dtype=kind, count=sets, offset=at))
        at += cols[-1].nbytes
    wide = np.zeros((keys, 8), dtype=np.uint8)
    wide[:, :5] = np.frombuffer(data, dtype=np.uint8, offset=at).reshape(keys, 5)
    short = wide.view("<u8")[:, 0]
    sid, fp, n, count = cols
    return short >> np.uint64(1), np.repeat(sid, count), np.repeat(n.astype(np.int64), count), (short & np.uint64(1)).astype(bool), np.repeat(fp, count)


def _shard_rows(batches: Iterator[pa.RecordBatch], common: dict[str, int], hot: dict[int, int], parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys of the shards of (field_name, sid, n, words), packed by part; lead: the set may be the smaller partner there. ``hot``: blocks of large shards."""
    held: list[tuple[np.ndarray, ...]] = []
    keys, blocks = np.array(sorted(hot), dtype=np.uint64), np.array([hot[k] for k in sorted(hot)], dtype=np.int64)
    for found in _shard_keys(batches, common):
        held.append(_tiled(*found, keys, blocks))
        if sum(x[3].size for x in held) >= 2_000_000:
            yield from _joined(held, parts)
            held = []
    if held:
        yield from _joined(held, parts)


def _tiled(sid, n, fp, key, lead, who, hot, blocks) -> tuple[np.ndarray, ...]:
    """The keys with those of hot shards as tiles: a row of block x goes to the tiles of x with each other block."""
    if not hot.size:
        return sid, n, fp, key, lead, who
    at = np.minimum(np.searchsorted(hot, key), hot.size - 1)
    is_hot = hot[at] == key
    if not is_hot.any():
        return sid, n, fp, key, lead, who
    b = blocks[at[is_hot]]
    own = (_mixed(sid[who[is_hot]].view(np.uint64)) % b.astype(np.uint64)).astype(np.int64)
    row = np.repeat(np.arange(b.size), b - 1)
    other = np.arange(row.size) - np.repeat(np.cumsum(b - 1) - (b - 1), b - 1)
    other += other >= own[row]
    x, y = np.minimum(own[row], other), np.maximum(own[row], other)
    tile = _mixed(key[is_hot][row] * _M1 + (x * b[row] + y).astype(np.uint64) * _M2 + np.uint64(1))
    return sid, n, fp, np.concatenate([key[~is_hot], tile]), np.concatenate([lead[~is_hot], lead[is_hot][row]]), np.concatenate([who[~is_hot], who[is_hot][row]])


def _joined(held: list[tuple[np.ndarray, ...]], parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    before = np.cumsum([0, *(x[0].size for x in held)])
    sid, n, fp, key, lead = (np.concatenate([x[i] for x in held]) for i in range(5))
    yield from _packed(parts, sid, n, fp, key, lead, np.concatenate([x[5] + b for x, b in zip(held, before[:-1], strict=True)]))


def _shard_keys(batches: Iterator[pa.RecordBatch], common: dict[str, int], above: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(sid, n, fp) of the sets of a batch and (key, lead, set's place in the batch) of their shards.

    With ``above`` only the shards of words that are all in more sets than that: no other shard can have more rows.
    """
    table = _Words(common)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            if len(table) > 1_000_000:
                table = _Words(common)
            n = part.column(2).to_numpy().astype(np.int64)
            flat = np.array([table[w] for words in part.column(3).to_pylist() for w in words.split(" ")], dtype=np.int64)
            row = np.repeat(np.arange(n.size), n)
            begin = np.cumsum(n) - n
            h, rank, often = np.array(table.hashes, dtype=np.uint64)[flat], np.array(table.ranks, dtype=np.int64)[flat], np.array(table.often, dtype=bool)[flat]
            many = rank >= (1 << 62) + ((above + 1) << 20) if above is not None else None
            fp = np.bitwise_xor.reduceat(np.uint64(1) << (h & np.uint64(63)), begin)
            order = np.lexsort((h, rank, row))
            h, often = h[order], often[order]
            many = many[order] if many is not None else np.ones(h.size, dtype=bool)
            fields = {f: np.uint64(_hash(f)) for f in set(part.column(0).to_pylist())}
            salt = np.array([fields[f] for f in part.column(0).to_pylist()], dtype=np.uint64)
            sid = part.column(1).to_numpy()
            as_large, as_small = prefix_lengths(n)
            keys, rows, leads = [], [], []

            def put(who: np.ndarray, key: np.ndarray, reach: np.ndarray, lead: np.ndarray, salt=salt, keys=keys, rows=rows, leads=leads) -> None:
                keys.append(_mixed(key + salt[who])), rows.append(who), leads.append(lead[who] & reach)

            small = n <= PAIR_WORDS
            two = np.flatnonzero(n <= PAIR_WORDS * 10 // 7)
            width = int(as_large[two].max()) + 1 if two.size else 0
            for j in range(width):
                a = two[j < as_large[two] + 1]
                one = a[~often[begin[a] + j] & (above is None)]
                put(one, h[begin[one] + j], j < as_small[one] + 1, small)
                for i in range(j):
                    b = a[often[begin[a] + i] & often[begin[a] + j] & many[begin[a] + i] & many[begin[a] + j]]
                    put(b, h[begin[b] + i] * _M1 + h[begin[b] + j], j < as_small[b] + 1, small)
            for k in np.flatnonzero(~small):
                at = np.flatnonzero(many[begin[k] : begin[k] + as_large[k]])
                put(np.full(at.size, k), h[begin[k] + at] + _M2, at < as_small[k], ~small)
            if not rows:
                continue
            who = np.concatenate(rows)
            yield sid, n, fp, np.concatenate(keys), np.concatenate(leads), who


def _near(fp: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[i] ^ fp[j]) <= 3 * (n[i] + n[j]) // 17


def _linear(key: np.ndarray, n: np.ndarray, lead: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (i, j), i the smaller set, of rows sorted by (key, n): neighbours at distance 1, 2, ... in a shard."""
    i = np.flatnonzero(lead)
    step = 1
    while i.size:
        i = i[i + step < key.size]
        j = i + step
        near = (key[i] == key[j]) & (7 * n[j] <= 10 * n[i])  # both end for good once they end
        i = i[near]
        hit = i[_near(fp, n, i, i + step)]
        if hit.size:
            yield hit, hit + step
        step += 1


def vantage_pairs(n: np.ndarray, lead: np.ndarray, fp: np.ndarray, at: np.ndarray | None = None, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (i, j) of one shard, by a vantage-point tree over the fingerprints; n is sorted.

    A node's rows are divided by their distance to its vantage point. A pair on two sides of the boundary is at least
    (outer distance - inner distance) apart, so only rows within the ball's radius of the boundary are
    joined across it. The boundary is the one with the least pairs left to compare; a node in which none saves a fifth of them is compared row by row.
    """
    at = np.arange(n.size) if at is None else at
    inner, outer, rim = _divided(n, fp, at) if at.size > leaf else (at, at[:0], None)
    if rim is None:
        for i, j in _linear(np.zeros(at.size, dtype=np.int64), n[at], lead[at], fp[at]):
            yield at[i], at[j]
        return
    yield from vantage_pairs(n, lead, fp, inner, leaf)
    yield from vantage_pairs(n, lead, fp, outer, leaf)
    yield from _across(n, lead, fp, *rim)


def _divided(n: np.ndarray, fp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """(rows within the boundary, rows beyond it, the rows of both within reach of it) of a node; no rim where the node isn't worth a division."""
    d = np.bitwise_count(fp[at] ^ fp[at[at.size // 2]]).astype(np.int64)
    reach = int(6 * n[at].max() // 17)
    upto = np.concatenate([np.zeros(reach + 1, dtype=np.int64), np.cumsum(np.bincount(d, minlength=65)), np.full(reach, at.size)])  # upto[x + reach + 1]: rows at distance x or less
    x = np.arange(65) + reach + 1
    within, below, beyond = upto[x], upto[x - reach], upto[np.minimum(x + reach, upto.size - 1)]
    work = within**2 + (at.size - within) ** 2 + 2 * (within - below) * (beyond - within)
    r = int(np.argmin(work))
    if work[r] > 0.8 * at.size**2:
        return at, at[:0], None
    near = d <= r
    return at[near], at[~near], (at[near & (d > r - reach)], at[~near & (d <= r + reach)])


def _across(n: np.ndarray, lead: np.ndarray, fp: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates between two disjoint groups of rows, in blocks."""
    for a in range(0, left.size, 1024):
        for b in range(0, right.size, 1024):
            x, y = left[a : a + 1024, None], right[None, b : b + 1024]
            near = (np.bitwise_count(fp[x] ^ fp[y]) <= 3 * (n[x] + n[y]) // 17) & (7 * np.maximum(n[x], n[y]) <= 10 * np.minimum(n[x], n[y]))
            near &= (lead[x] & (n[x] <= n[y])) | (lead[y] & (n[y] <= n[x]))
            i, j = np.nonzero(near)
            if i.size:
                yield left[a + i], right[b + j]


_PAIR = "a bigint, b bigint"
_HELD_PAIRS = 1_000_000


def _distinct(pairs: list[tuple[np.ndarray, np.ndarray]], sid: np.ndarray) -> pa.RecordBatch:
    i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64) for k in (0, 1))
    both = np.unique(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])], axis=1), axis=0)
    both = both[both[:, 0] < both[:, 1]]
    return pa.record_batch([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], names=["a", "b"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of the packed rows of one part after the other; rows are sorted by part."""
    held: list[tuple[np.ndarray, ...]] = []
    now = None
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != now and held:
                yield from _shards_of_part(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
            now = part
            held.append(_unpacked(data.as_py()))
    if held:
        yield from _shards_of_part(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _shards_of_part(key: np.ndarray, sid: np.ndarray, n: np.ndarray, lead: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((n, key))
    key, sid, n, lead, fp = key[order], sid[order], n[order], lead[order], fp[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([begins, [key.size]]))
    of = np.flatnonzero(np.repeat(sizes <= LEAF, sizes))
    found = ((of[i], of[j]) for i, j in _linear(key[of], n[of], lead[of], fp[of]))
    trees = ((begin + i, begin + j) for begin, size in zip(begins[sizes > LEAF], sizes[sizes > LEAF], strict=True) for i, j in vantage_pairs(n[begin : begin + size], lead[begin : begin + size], fp[begin : begin + size]))
    pairs, held = [], 0
    for pair in itertools.chain(found, trees):
        pairs.append(pair)
        held += pair[0].size
        if held > _HELD_PAIRS:
            yield _distinct(pairs, sid)
            pairs, held = [], 0
    yield _distinct(pairs, sid)


def _hot_shards(sets: DataFrame, common: Broadcast, tile: int) -> dict[int, int]:
    """key -> number of blocks (two at least) of the shards with more than ``tile`` rows.

    Only words in more than ``tile`` sets can make one: there are at most (words of all sets / tile) of them, and the keys that come out are as few.
    """
    if sum(c > tile for c in common.value.values()) < 1:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for *_, key, _, _ in _shard_keys(batches, common.value, tile):
            seen.update(dict(zip(*(x.tolist() for x in np.unique(key.view(np.int64), return_counts=True)), strict=True)))
            if len(seen) > 500_000:
                yield pa.record_batch([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["key", "n"])
                seen.clear()
        yield pa.record_batch([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["key", "n"])

    rows = sets.select("field_name", "sid", "n", "words").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > tile).collect()
    return {r["key"] % 2**64: -(-2 * r["n"] // tile) for r in rows}


def _part_names(spark: SparkSession, parts: int) -> np.ndarray:
    """A name for each part, so that hash partitioning by name puts every part into a partition of its own."""
    ids = spark.range(0, 64 * parts + 1024).select(F.col("id").cast("int").alias("name"))
    rows = ids.groupBy(F.pmod(F.hash("name"), F.lit(parts)).alias("p")).agg(F.min("name").alias("name")).collect()  # a row a partition
    return np.array([r["name"] for r in rows], dtype=np.int64)


def alike_sets(sets: DataFrame, tile: int = TILE) -> DataFrame:
    """(field_name, s_a, s_b) of the staged distinct sets (field_name, sid, s, n, words) with similarity of 0.7 or more; s_a < s_b."""
    spark = sets.sparkSession
    common = spark.sparkContext.broadcast(_common_words(sets, tile))
    hot = spark.sparkContext.broadcast(_hot_shards(sets, common, tile))
    parts = max(shuffle_partitions(spark), -(-sets.count() // SETS_PER_PART))
    names = _part_names(spark, parts)
    shards = sets.select("field_name", "sid", "n", "words").mapInArrow(lambda it: _shard_rows(it, common.value, hot.value, names), "part int, data binary")
    pairs = stage(shards.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_shards, _PAIR).distinct(), "candidates")  # the keys' shuffle can go before the joins begin
    left = sets.select(F.col("sid").alias("a"), "field_name", F.col("s").alias("s_l"), F.col("words").alias("words_l"), F.col("n").alias("n_l"))
    right = sets.select(F.col("sid").alias("b"), F.col("s").alias("s_r"), F.col("words").alias("words_r"), F.col("n").alias("n_r"))
    pairs = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect(F.split("words_l", " "), F.split("words_r", " "))))
    pairs = pairs.filter("10 * both >= 7 * (n_l + n_r - both)")
    return pairs.select("field_name", F.least("s_l", "s_r").alias("s_a"), F.greatest("s_l", "s_r").alias("s_b"))


def distinct_sets(members: DataFrame) -> DataFrame:
    """The distinct word sets of :func:`word_sets`, numbered and staged, with the number of their rows."""
    sets = members.groupBy("field_name", "s").agg(F.first("n").alias("n"), F.first("words").alias("words"), F.count("*").alias("rows"))
    return stage(sets.select("field_name", F.monotonically_increasing_id().alias("sid"), "s", "n", "words", "rows"), "sets")


def alike_pairs(records: DataFrame, tile: int = TILE) -> DataFrame:
    """(field_name, id_a, id_b): all pairs of different records alike in a field, id_a < id_b.

    ``records`` is (field_name, id, text); an id that stands on several rows is one record.
    """
    members = stage(word_sets(records), "words")
    sets = distinct_sets(members)
    links = stage(alike_sets(sets, tile), "links")
    who = members.select("field_name", "s", "id").distinct()
    a, b = (who.select("field_name", F.col("s").alias(f"s_{x}"), F.col("id").alias(f"i_{x}")) for x in "ab")
    # copies: a class meets itself in blocks, so one with a third of all records is written by many tasks
    crowds = sets.filter(F.col("rows") > COPIES).select("field_name", "s", F.ceil(F.col("rows") / F.lit(COPIES)).cast("int").alias("blocks"))
    copies = who.join(broadcast_if_small(crowds, 100_000), ["field_name", "s"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    left = copies.select("field_name", "s", F.col("id").alias("i_a"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    right = copies.select("field_name", "s", F.col("id").alias("i_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    same = left.join(right, ["field_name", "s", "block"]).filter("i_a < i_b").select("field_name", "i_a", "i_b")
    other = links.join(a, ["field_name", "s_a"]).join(b, ["field_name", "s_b"]).filter("i_a <> i_b").select("field_name", "i_a", "i_b")
    both = same.unionByName(other)
    return both.select("field_name", F.least("i_a", "i_b").alias("id_a"), F.greatest("i_a", "i_b").alias("id_b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, root) for every end of the edges (u, v): root is the least name in its component.

    Alternating large and small stars: each round hangs every vertex under a smaller one, and each
    vertex keeps few edges, so a hub's neighbours are never in one row. Rounds are logarithmic in the size.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = stage(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError("the components did not settle")


def alike_groups(records: DataFrame, tile: int = TILE) -> DataFrame:
    """(field_name, id, group_id, n_links): each record with its class and the number of records it is alike to.

    group_id is the hash of the least word set of the class (of a lone record: of its own set); copies stay in
    one class without being expanded into pairs. Texts with fewer than 8 different words have no row.
    """
    members = stage(word_sets(records).select("field_name", "id", "s", "n", "words"), "words")
    links = stage(alike_sets(distinct_sets(members), tile), "links")
    who = members.select("field_name", "s", "id").distinct()
    sizes = who.groupBy("field_name", "s").agg(F.count("*").alias("copies"))
    ends = links.select("field_name", F.col("s_a").alias("s"), F.col("s_b").alias("t")).unionByName(links.select("field_name", F.col("s_b").alias("s"), F.col("s_a").alias("t")))
    degree = ends.join(sizes.withColumnRenamed("s", "t"), ["field_name", "t"]).groupBy("field_name", "s").agg(F.sum("copies").alias("others"))
    roots = components(links.select(F.struct("field_name", F.col("s_a").alias("s")).alias("u"), F.struct("field_name", F.col("s_b").alias("s")).alias("v")))
    roots = roots.select("u.field_name", "u.s", F.col("root.s").alias("root"))
    sets = sizes.join(degree, ["field_name", "s"], "left").join(roots, ["field_name", "s"], "left")
    sets = sets.select("field_name", "s", F.coalesce("root", "s").alias("group_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return who.join(sets, ["field_name", "s"]).select("field_name", "id", "group_id", "n_links")
