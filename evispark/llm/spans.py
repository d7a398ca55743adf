"""Long exact spans shared between records, over a log-structured index of window hashes.

Every span of 200 characters holds 145 windows of 56; of each such row of windows the one with the least
hash is an anchor (winnowing), so two texts that share 200 characters share an anchor there, and one window
in about 73 is kept. The index is a log of runs: each batch of texts writes its anchors once, as a table in buckets of the hash, sorted within each, and
no run is ever changed. A batch is merge-joined with each run, bucket by bucket: its own hashes are shuffled once, when they are written, and the
history is read where it lies, never shuffled or sorted again. Runs are compacted into one when there are many.

What a text shares is the union of its 200-character grams that stand in another text too. Each such gram lies in
the context of a shared anchor (144 characters to both sides). Contexts that are the same in two texts
are settled by a hash in the index; only the others, at the ends of shared spans, are read from the texts and
compared gram by gram: within one task for the usual anchor, by a grouped join for an anchor with very many
contexts. So work grows with occurrences, never with pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evispark.staging import drop_path, shared_dir, shuffle_partitions, stage

MIN_CHARS = 200
WINDOW = 56
ROW = MIN_CHARS - WINDOW + 1
REACH = MIN_CHARS - WINDOW
#: Anchors with more different contexts than this are compared by the grouped join.
HOT_CONTEXTS = 4096
_BLOCK = 2**20
_BASE, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or _POWERS["up"].size < n:
        size = max(n, _BLOCK + 2**16)
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX1
    return (x ^ (x >> np.uint64(29))) * _MIX2


class Hashes:
    """Hashes of any part of a row of characters, from prefix sums of a polynomial modulo 2^64 over mixed characters."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self.down = _powers(codes.size + 1)
        self.sums = np.zeros(codes.size + 1, dtype=np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * up[: codes.size], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        n = self.sums.size - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)

    def parts(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stops] - self.sums[starts]) * self.down[starts])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while have < size:
        step = min(have, size - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _anchors(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts in one row of ``codes``: (text number, place, hash, context hash) of each anchor."""
    ends = np.cumsum(lengths)
    hashes = Hashes(codes)
    grams = hashes.windows(WINDOW)
    bits = np.uint64(int(codes.size).bit_length())
    ranked = ((grams >> bits) << bits) | np.arange(grams.size, dtype=np.uint64)
    least = _sliding_min(ranked, ROW)
    of = np.repeat(np.arange(lengths.size), lengths)
    least = least[of[: least.size] == of[MIN_CHARS - 1 : MIN_CHARS - 1 + least.size]]  # rows within one text
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if at.size:
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        h = grams[at]
        run = np.concatenate([[False], (at[1:] == at[:-1] + 1) & (h[1:] == h[:-1])])  # one character on and on
        if run.any():
            begins = np.maximum.accumulate(np.where(run, 0, np.arange(at.size)))
            last = np.concatenate([~run[1:], [True]])
            at = at[~run | last | ((np.arange(at.size) - begins) % ROW == 0)]
    doc = of[at]
    begin = ends[doc] - lengths[doc]
    left, right = np.minimum(REACH, at - begin), np.minimum(REACH, ends[doc] - at - WINDOW)
    context = hashes.parts(at - left, at + WINDOW + right) + _mixed((left * 1024 + right).astype(np.uint64))
    return doc, at - begin, grams[at].view(np.int64), context.view(np.int64)


def anchors(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, c, d, p, n): hash and context hash, document and place of each anchor, and the text's length.

    Texts under 200 characters, null ones among them, have none. ``key`` is a bigint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = [], [], 0

        def out() -> pa.RecordBatch:
            lengths = np.array([x.size for x in parts], dtype=np.int64)
            doc, p, h, c = _anchors(lengths, np.concatenate(parts))
            return pa.record_batch([pa.array(h), pa.array(c), pa.array(np.array(ids, dtype=np.int64)[doc]), pa.array(p.astype(np.int32)), pa.array(lengths[doc].astype(np.int32))], names=["h", "c", "d", "p", "n"])

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and len(text) >= MIN_CHARS and d is not None:
                    ids.append(d), parts.append(_codes(text))
                    size += parts[-1].size
                    if size >= _BLOCK:
                        yield out()
                        ids, parts, size = [], [], 0
        if parts:
            yield out()

    return docs.select(F.col(key).cast("bigint"), text_col).mapInArrow(run, "h bigint, c bigint, d bigint, p int, n int")


class SpanIndex:
    """The log of runs in a folder: tables in buckets of the hash, sorted within each bucket, that never change.

    All runs have the same number of ``buckets``, so a run and a batch meet without an exchange of the run.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, max_runs: int = 8, buckets: int | None = None) -> None:
        self.spark, self.max_runs = spark, max_runs
        self.path = path or f"{shared_dir(spark)}/spans-{uuid.uuid4().hex}"
        self.buckets = buckets or shuffle_partitions(spark)
        self.runs: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"spans_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        return name

    def append(self, batch: DataFrame) -> DataFrame:
        """Write the anchors of a batch as the newest run and give it back."""
        if len(self.runs) >= self.max_runs:
            self.compact()
        self.runs.append(self._write(batch))
        return self.read(self.runs[-1])

    def read(self, run: str) -> DataFrame:
        return self.spark.table(run)

    def compact(self) -> None:
        """Merge all runs into one; the old ones go afterwards."""
        old = self.runs
        self.runs = [self._write(reduce(DataFrame.unionByName, [self.read(r) for r in old]))]
        self._drop(old)

    def _drop(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        self._drop(self.runs)
        drop_path(self.spark, self.path)


def _gram_rows(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its context, key of (anchor, gram)) of each 200-character gram of contexts (h, ..., ctx)."""
    codes = [_codes(t) for t in batch["ctx"].to_pylist()]
    lengths = np.array([x.size for x in codes], dtype=np.int64)
    count = np.maximum(0, lengths - MIN_CHARS + 1)
    row = np.repeat(np.arange(lengths.size), count)
    place = np.arange(row.size) - np.repeat(np.cumsum(count) - count, count)
    grams = Hashes(np.concatenate(codes) if codes else np.zeros(0, np.uint32)).windows(MIN_CHARS)
    at = (np.cumsum(lengths) - lengths)[row] + place
    h = batch["h"].to_numpy().view(np.uint64)
    return row, place, _mixed(_mixed(h)[row] + grams[at]) if row.size else np.zeros(0, dtype=np.uint64)


_INTERVALS = "h bigint, c bigint, a int, b int"


def _intervals(batch: pa.Table, row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring grams as intervals relative to the anchor; rows and places are sorted."""
    if row.size:
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
        first, last = np.flatnonzero(new), np.concatenate([np.flatnonzero(new)[1:], [row.size]]) - 1
        left = batch["left"].to_numpy()[row[first]]
        a, b, of = place[first] - left, place[last] + MIN_CHARS - left, row[first]
    else:
        a = b = of = np.zeros(0, dtype=np.int64)
    cols = [batch[c].to_numpy()[of] for c in ("h", "c")] + [a.astype(np.int32), b.astype(np.int32)]
    return pa.record_batch([pa.array(x) for x in cols], names=["h", "c", "a", "b"])


def _compare(batch: pa.Table) -> pa.RecordBatch:
    """Intervals of the contexts of one document whose grams stand in another document's context of the anchor."""
    row, place, key = _gram_rows(batch)
    d, multi = batch["d"].to_numpy()[row], batch["multi"].to_numpy(zero_copy_only=False)
    order = np.lexsort((d, key))
    begins = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if order.size else np.zeros(0, dtype=np.int64)
    if not begins.size:
        return _intervals(batch, row, place)
    stops = np.concatenate([begins[1:], [order.size]])
    shared = (d[order[begins]] != d[order[stops - 1]]) | np.logical_or.reduceat(multi[row[order]], begins)
    group = np.empty(order.size, dtype=np.int64)
    group[order] = np.repeat(np.arange(begins.size), stops - begins)
    keep = np.flatnonzero(shared[group] & ~multi[row])
    # the texts themselves confirm what the hashes say
    texts = batch["ctx"].to_pylist()
    other = np.where(d[order[begins]][group[keep]] != d[keep], order[begins][group[keep]], order[stops - 1][group[keep]])
    ends = np.concatenate([[True], (row[keep][1:] != row[keep][:-1]) | (place[keep][1:] != place[keep][:-1] + 1)]) if keep.size else np.zeros(0, dtype=bool)
    ends[:-1] |= ends[1:].copy()
    good = np.ones(keep.size, dtype=bool)
    for i in np.flatnonzero(ends):
        x, y = keep[i], other[i]
        good[i] = texts[row[x]][place[x] : place[x] + MIN_CHARS] == texts[row[y]][place[y] : place[y] + MIN_CHARS]
    keep = keep[good]
    return _intervals(batch, row[keep], place[keep])


def _whole_groups(batches: Iterator[pa.RecordBatch], size: int = 2048) -> Iterator[pa.Table]:
    """Tables of about ``size`` rows that hold whole groups of the sorted column h."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            rows = pa.Table.from_batches(held)
            h = rows["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))
            if cut:
                yield rows.slice(0, cut)
                held = rows.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _edge_intervals(contexts: DataFrame) -> DataFrame:
    """(h, c, a, b) for contexts (h, c, d, left, multi, hot, ctx) of one document."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            yield _compare(rows)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            row, place, key = _gram_rows(rows)
            cols = {c: pa.array(rows[c].to_numpy(zero_copy_only=False)[row]) for c in ("h", "c", "d", "multi")}
            yield pa.record_batch(cols | {"g": pa.array(key.view(np.int64)), "a": pa.array((place - rows["left"].to_numpy()[row]).astype(np.int32))})

    usual = contexts.filter("not hot").repartition("h").sortWithinPartitions("h").mapInArrow(compare, _INTERVALS)
    grams = contexts.filter("hot").mapInArrow(explode, "h bigint, c bigint, d bigint, multi boolean, g bigint, a int")
    shared = grams.groupBy("h", "g").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.max("multi").alias("m")).filter("m or d0 <> d1")
    hot = grams.filter("not multi").join(shared.select("h", "g"), ["h", "g"], "left_semi").select("h", "c", "a", (F.col("a") + MIN_CHARS).alias("b"))
    return usual.unionByName(hot)


def _shared_anchors(index: SpanIndex, fresh: DataFrame) -> DataFrame:
    """The anchors of ``fresh`` that stand in another document, of that run or an earlier one, and theirs there.

    Each run is merge-joined with the hashes of the newest one; only what meets leaves its run.
    """
    own = fresh.groupBy("h").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    met = [index.read(r).join(own.select("h").hint("merge"), "h", "left_semi") for r in index.runs[:-1]]
    if not met:
        return fresh.join(own.filter("d0 <> d1").select("h").hint("merge"), "h", "left_semi")
    old = stage(reduce(DataFrame.unionByName, met), "met")
    both = old.groupBy("h").agg(F.min("d").alias("e0"), F.max("d").alias("e1"))
    seen = own.join(both.hint("shuffle_merge"), "h", "left").filter("d0 <> d1 or e0 <> e1 or e0 <> d0").select("h")
    seen = stage(seen, "seen")
    return fresh.join(seen.hint("merge"), "h", "left_semi").unionByName(old.join(seen, "h", "left_semi"))


def _spans_of_batch(index: SpanIndex, fresh: DataFrame, docs: DataFrame, hot_contexts: int) -> DataFrame:
    """(d, s, e): parts shared through anchors of the newest run ``fresh`` of the index."""
    shared = stage(_shared_anchors(index, fresh), "anchors")
    groups = shared.groupBy("h", "c").agg(F.min(F.struct("d", "p")).alias("rep"), F.max("d").alias("d1"))
    groups = stage(groups.select("h", "c", "rep.d", "rep.p", (F.col("rep.d") != F.col("d1")).alias("multi")), "contexts")
    whole = shared.join(groups.filter("multi").select("h", "c"), ["h", "c"], "left_semi")
    whole = whole.select("d", F.greatest(F.col("p") - REACH, F.lit(0)).alias("s"), F.least(F.col("p") + WINDOW + REACH, F.col("n")).alias("e")).filter(F.col("e") - F.col("s") >= MIN_CHARS)

    open_ = groups.groupBy("h").agg(F.count("*").alias("n_contexts"), F.min("multi").alias("closed")).filter("not closed").select("h", (F.col("n_contexts") > hot_contexts).alias("hot"))
    wanted = stage(groups.join(open_, "h").groupBy("d").agg(F.collect_list(F.struct("h", "c", "p", "multi", "hot")).alias("at")), "wanted")  # within one text
    ids = wanted.select("d")
    texts = docs.join(F.broadcast(ids), "d", "left_semi") if wanted.count() <= 1_000_000 else docs  # 8 MB of ids at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("h", "c", "d", "left", "multi", "hot", "ctx")}
            for d, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in at:
                    left = min(REACH, x["p"])
                    for c, v in (("h", x["h"]), ("c", x["c"]), ("d", d), ("left", left), ("multi", x["multi"]), ("hot", x["hot"]), ("ctx", text[x["p"] - left : x["p"] + WINDOW + REACH])):
                        out[c].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    contexts = stage(wanted.join(texts, "d").select("d", "at", "text").mapInArrow(cut, "h bigint, c bigint, d bigint, left int, multi boolean, hot boolean, ctx string"), "texts")
    edges = shared.join(_edge_intervals(contexts), ["h", "c"]).select("d", (F.col("p") + F.col("a")).alias("s"), (F.col("p") + F.col("b")).alias("e"))
    return whole.unionByName(edges).distinct()


def merge_spans(spans: DataFrame) -> DataFrame:
    """(d, s, e) with overlapping and touching spans of a document as one."""
    w = Window.partitionBy("d").orderBy("s", "e")
    rows = spans.withColumn("before", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("part", F.sum(F.when(F.col("s") <= F.col("before"), 0).otherwise(1)).over(w))
    return rows.groupBy("d", "part").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("part")


#: Batches in which documents come to the index, and runs that it holds before it is compacted: the third batch finds the first two as one run.
BATCHES, MAX_RUNS = 3, 2


def shared_spans(docs: DataFrame, key: str = "doc_id", text_col: str = "text", batches: int = BATCHES, hot_contexts: int = HOT_CONTEXTS, max_runs: int = MAX_RUNS) -> DataFrame:
    """(doc_id, start_char, end_char): the parts of each text that spans of 200 characters or more share with another document.

    Documents come in ``batches`` to the index, as they would day by day, and each is matched with all before it.
    Null and short texts, and documents without an id, share nothing; rows repeated under one id are one document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("d"), F.col(text_col).alias("text")).filter(F.col("d").isNotNull() & (F.length("text") >= MIN_CHARS))
    index, found = SpanIndex(spark, max_runs=max_runs), None
    for i in range(batches):
        part = rows.filter(F.pmod(F.xxhash64("d"), F.lit(batches)) == i)
        fresh = index.append(anchors(part, "d"))
        new = stage(_spans_of_batch(index, fresh, rows, hot_contexts), "spans")
        found = new if found is None else found.unionByName(new)
    index.drop()
    return merge_spans(found.distinct()).select(F.col("d").cast(docs.schema[key].dataType).alias(key), F.col("s").alias("start_char"), F.col("e").alias("end_char"))


def shared_shares(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every document; the share of a null or empty text is 0."""
    sums = spans.groupBy(key).agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    rows = docs.select(key, F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars")).join(sums, key, "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return rows.withColumn("shared_share", F.round(F.coalesce(F.try_divide(F.col("shared_chars"), F.col("n_chars")), F.lit(0.0)), 9))
