"""Splitting of oversized texts at natural boundaries, range by range.

A text is seen as ranges of bytes. A range knows its own bytes, a halo of bytes to its left, and, by a prefix sum of the ranges' lengths,
the place of its first character. Every 16 pieces' length a block ends, at the best boundary before that place; as
this boundary depends only on the text around it, the range that holds a block's end finds it, and finds the end of the block
before again in the halo: tables of boundaries of neighbouring ranges agree, blocks are cut apart from each other, and no task walks through a
whole text. Ranges count their pieces, and a prefix sum over the counts numbers them through the text. Within a block pieces are as long as they may be: each ends at the best boundary (paragraph, sentence, line, word; the last one of the best
kind) in the latter half of its new text, else at the last one of the best kind in all of its new text, and only if there is none at its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evispark.staging import broadcast_if_small, stage

RANGE_BYTES = 2**20
BLOCK_PIECES = 16
#: Ends of sentences: Latin ones need a blank behind them, full-width ones don't.
_SENTENCE = re.compile(r"[.!?][\"')\]’”]*(?=\s)|[。！？][”’」』]*")


def _cut(text: str, base: int, end: int, window: int) -> int | None:
    """The place of the best boundary among the last ``window`` places up to ``end``; ``text`` begins at place ``base``."""
    hi = end - base
    lo = max(0, hi - window)  # cuts lie in (lo, hi]
    at = text.rfind("\n\n", max(0, lo - 1), hi)
    if at >= 0 and at + 2 > lo:
        return base + at + 2
    last = 0
    for m in _SENTENCE.finditer(text, max(0, lo - 4), min(len(text), hi + 1)):
        stop = m.end() + (m.end() < hi and text[m.end()].isspace())  # the blank stays with its sentence
        if lo < stop <= hi:
            last = stop
    if last:
        return base + last
    for mark in ("\n", " "):
        at = text.rfind(mark, lo, hi)
        if at >= 0:
            return base + at + 1
    return None


def pieces_of_range(text: str, base: int, first: int, stop: int, total: int, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """(piece_no, start, end) of the pieces of the blocks that end in the characters (first, stop] of a text of ``total``.

    ``text`` is the part from place ``base``; it reaches back by at least :func:`_reach` (or to the text's begin). An overlap of max_chars or more
    is brought below it. Numbers begin with 1 in each range and rise along the text.
    """
    overlap = min(max(0, overlap), max_chars - 1)
    block = BLOCK_PIECES * max_chars
    blocks = max(0, total - max_chars) // block  # those that are full; the last one takes the rest
    end_of = lambda m: (_cut(text, base, m * block, max_chars - overlap) or m * block) if m else 0
    out: list[tuple[int, int, int]] = []

    def fill(begin: int, end: int) -> None:
        while True:
            start = max(0, begin - overlap)
            if end - start <= max_chars:
                out.append((len(out) + 1, start, end))
                return
            limit = start + max_chars
            begin = _cut(text, base, limit, (limit - begin) // 2) or _cut(text, base, limit, limit - begin) or limit
            out.append((len(out) + 1, start, begin))

    for m in range(first // block + 1, min(stop // block, blocks) + 1):
        fill(end_of(m - 1), end_of(m))
    if stop == total > first:
        fill(end_of(blocks), total)
    return out


def _reach(max_chars: int) -> int:
    return (BLOCK_PIECES + 4) * max_chars + 16


_PLACED = "range_no int, piece_no bigint, start bigint, end bigint, text string"


def _pieces(batches: Iterator[pa.RecordBatch], count: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of (item, range_no, max_chars, overlap, char0, n_chars, halo, body, ahead) to rows of (item, range_no, piece_no, start, end, text).

    Or, to ``count`` pieces only, to rows of (item, range_no, n).
    """
    for batch in batches:
        items, col = batch.column("item"), {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "item"}
        of, no, starts, ends, texts = [], [], [], [], []
        for i in range(batch.num_rows):
            halo, body = col["halo"][i], col["body"][i]
            back = halo.lstrip(_CONTINUATION)
            text = (back + body + col["ahead"][i]).decode("utf-8", "ignore")
            base = col["char0"][i] - _leads(back)
            first, stop = col["char0"][i], col["char0"][i] + _leads(body)
            for k, a, b in pieces_of_range(text, base, first, stop, col["n_chars"][i], col["max_chars"][i], col["overlap"][i]):
                of.append(i), no.append(k), starts.append(a), ends.append(b), texts.append("" if count else text[a - base : b - base])
        if count:
            yield pa.record_batch([items, batch.column("range_no"), pa.array(np.bincount(np.array(of, dtype=np.int64), minlength=batch.num_rows))], names=["item", "range_no", "n"])
        else:
            at = pa.array(of, pa.int32())
            yield pa.record_batch([items.take(at), batch.column("range_no").take(at), pa.array(no, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string())], names=["item", "range_no", "piece_no", "start", "end", "text"])


def _numbered(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """``pieces`` with numbers through the item: by ``counts`` (item, range_no, n) of the ranges of items that have several, whose prefix sums are joined by range."""
    w = Window.partitionBy("item").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a number a range
    before = stage(counts.withColumn("before", F.sum("n").over(w)).filter("before > 0").select(F.col("item").alias("_item"), F.col("range_no").alias("_no"), "before"), "before")
    rows = pieces.join(broadcast_if_small(before, 500_000), F.col("item").eqNullSafe(F.col("_item")) & (F.col("range_no") == F.col("_no")), "left")
    return rows.select("item", (F.col("piece_no") + F.coalesce("before", F.lit(0))).alias("piece_no"), "start", "end", "text")


_CONTINUATION = bytes(range(0x80, 0xC0))


def _leads(data: bytes) -> int:
    """Characters that begin in ``data``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    return int(((raw & 0xC0) != 0x80).sum())


def text_ranges(items: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of (item, max_chars, overlap, text) as their ranges, with halos and first characters.

    The slices are cut from the bytes of the cell, each once; characters are counted per slice and
    summed up over the slices of the cell.
    """
    data = items.withColumn("bytes", F.encode("text", "utf-8")).withColumn("n_chars", F.length("text").cast("bigint"))
    reach = f"4 * ({BLOCK_PIECES + 4} * max_chars + 16)"
    data = data.withColumn(
        "slices",
        F.expr(
            f"transform(sequence(0, cast((octet_length(bytes) - 1) div {range_bytes} as int)), i -> named_struct("
            f"'halo', substring(bytes, greatest(1, i * {range_bytes} - {reach} + 1), least(i * {range_bytes}, {reach})),"
            f"'body', substring(bytes, i * {range_bytes} + 1, {range_bytes}),"
            f"'ahead', substring(bytes, (i + 1) * {range_bytes} + 1, 16)))"
        ),
    )
    sizes = F.transform("slices", lambda s: F.length(F.regexp_replace(F.decode(s["body"], "ISO-8859-1"), "[\\x80-\\xBF]", "")).cast("bigint"))
    data = data.withColumn("sizes", sizes).withColumn("starts", F.expr("aggregate(sizes, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)))"))
    rows = data.select("item", "max_chars", "overlap", "n_chars", F.size("slices").alias("n_ranges"), F.posexplode(F.arrays_zip("slices", "starts")).alias("range_no", "z")).filter("z.slices is not null")
    return rows.select("item", "range_no", "n_ranges", "max_chars", "overlap", F.col("z.starts").alias("char0"), "n_chars", "z.slices.halo", "z.slices.body", "z.slices.ahead")


def split_texts(items: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of the items whose text has more than ``max_chars`` characters.

    ``items`` is (item, max_chars, overlap, text), item of any type. Gives (item, piece_no, start, end, text)
    with consecutive piece_no from 1 and half-open places in the text. Items without text or without a positive limit
    don't come out.
    """
    long = items.filter("max_chars > 0 and char_length(text) > max_chars").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    kind = items.schema["item"].dataType.simpleString()
    ranges = text_ranges(long.select("item", "max_chars", "overlap", "text"), range_bytes)
    counts = ranges.filter("n_ranges > 1").drop("n_ranges").mapInArrow(lambda it: _pieces(it, True), f"item {kind}, range_no int, n bigint")
    return _numbered(ranges.drop("n_ranges").mapInArrow(_pieces, f"item {kind}, {_PLACED}"), counts)


def _section(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def with_limits(items: DataFrame, limits: DataFrame) -> DataFrame:
    """``items`` (item_kind, section_type, ...) with max_chars and overlap of their row in ``limits``.

    The row of the same kind and, for chunks, the same section type (stripped, lower case); else the kind's row
    without a section type. Where a key has several rows the smallest limit holds.
    """
    rows = limits.select("item_kind", _section(F.col("section_type")).alias("limit_type"), F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap")).alias("lim")).filter("lim.max_chars > 0").groupBy("item_kind", "limit_type").agg(F.min("lim").alias("lim"))
    exact = broadcast_if_small(rows.filter("limit_type is not null").withColumnRenamed("lim", "exact"))
    default = broadcast_if_small(rows.filter("limit_type is null").select("item_kind", F.col("lim").alias("default")))
    wanted = F.when(F.col("item_kind") != "page", _section(F.col("section_type")))
    out = items.withColumn("limit_type", wanted).join(exact, ["item_kind", "limit_type"], "left").join(default, "item_kind", "left")
    out = out.withColumn("lim", F.coalesce("exact", "default")).drop("exact", "default", "limit_type")
    return out.select("*", F.col("lim.max_chars").alias("max_chars"), F.col("lim.overlap").alias("overlap")).drop("lim")


def _oversized(pages: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(item, max_chars, overlap, text) of the pages and chunks whose text is longer than their limit, once for each different content."""
    rows = pages.select(F.lit("page").alias("item_kind"), F.col("page_id").alias("item_id"), F.lit(None).cast("string").alias("section_type"), F.lit(0).cast("bigint").alias("base"), "text")
    rows = rows.unionByName(chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "section_type", F.col("start_char").cast("bigint").alias("base"), "text"))
    rows = with_limits(rows, limits).filter("char_length(text) > max_chars").withColumn("digest", F.sha2("text", 256)).dropDuplicates(["item_kind", "item_id", "section_type", "base", "digest"])
    return rows.select(F.struct("item_kind", "item_id", "section_type", "base", "digest").alias("item"), "max_chars", "overlap", "text")


def oversized_pieces(pages: DataFrame, chunks: DataFrame, limits: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of all oversized pages and chunks.

    (item_kind, item_id, section_type, piece_no, start_char, end_char, text); start_char and end_char are places in the page
    (for a chunk from its own start_char on, null where that is null). An item that was delivered repeatedly comes out
    once for each different content.
    """
    out = split_texts(_oversized(pages, chunks, limits), range_bytes)
    return out.select("item.item_kind", "item.item_id", "item.section_type", "piece_no", (F.col("item.base") + F.col("start")).alias("start_char"), (F.col("item.base") + F.col("end")).alias("end_char"), "text")


def piece_checks(pages: DataFrame, chunks: DataFrame, limits: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(item_kind, item_id, within_limit, overlapping, covered, numbered, verbatim) of each oversized item: what holds for its pieces.

    None is longer than the limit, each begins exactly the overlap before the end of the one before (or at 0), together they reach from the text's begin to its end,
    their numbers run from 1 without a gap, and each is the text at its places.
    """
    items = _oversized(pages, chunks, limits)
    p = _compared(split_texts(items, range_bytes), items)
    w = Window.partitionBy("item").orderBy("start", "end")  # places of one item's pieces
    before = F.lag("end").over(w)
    p = p.withColumn("before", before).withColumn("nth", F.row_number().over(w))
    per = p.groupBy("item").agg(F.min(F.col("end") - F.col("start") <= F.col("max_chars")).alias("within_limit"), F.min(F.when(F.col("before").isNull(), F.col("start") == 0).otherwise(F.col("start") == F.greatest(F.col("before") - F.col("overlap"), F.lit(0)))).alias("overlapping"), (F.max("end") == F.max("n")).alias("covered"), F.min(F.col("nth") == F.col("piece_no")).alias("numbered"), F.min("same").alias("verbatim"))
    checks = ("within_limit", "overlapping", "covered", "numbered", "verbatim")
    return per.groupBy("item.item_kind", "item.item_id").agg(*[F.min(c).alias(c) for c in checks])


def _compared(pieces: DataFrame, items: DataFrame) -> DataFrame:
    whole = items.select(F.col("item").alias("_item"), "max_chars", F.least(F.greatest("overlap", F.lit(0)), F.col("max_chars") - 1).alias("overlap"), F.col("text").alias("whole"))
    rows = pieces.join(whole, F.col("item").eqNullSafe(F.col("_item")))
    same = F.substring("whole", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("text")
    return rows.select("item", "piece_no", "start", "end", "max_chars", "overlap", F.length("whole").alias("n"), same.alias("same"))


def split_files(spark: SparkSession, files: list[str], max_chars: int, overlap: int, range_bytes: int = 8 * 2**20) -> DataFrame:
    """Pieces of giant UTF-8 files, none of which is ever loaded as a whole.

    (item = the file, piece_no, start, end, text). ``files`` are addresses that pyarrow.fs opens on every executor. A first
    pass counts the characters of each range and a prefix sum gives the ranges' places; a second one finds the boundaries of each range with its halo and counts its
    pieces; the last one emits the pieces by their places, numbered by the prefix sum of the counts.
    """
    from pyarrow import fs

    sizes = []
    for f in files:
        system, path = fs.FileSystem.from_uri(f)
        sizes.append((f, system.get_file_info(path).size))
    ranges = spark.createDataFrame(sizes, "item string, size bigint").filter("size > 0").select("item", "size", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size - 1) div {range_bytes} as int)"))).alias("range_no"))
    ranges = ranges.repartition("item", "range_no")

    def read(item: str, at: int, n: int) -> bytes:
        system, path = fs.FileSystem.from_uri(item)
        with system.open_input_file(path) as f:
            return f.read_at(n, at)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [_leads(read(item, no * range_bytes, range_bytes)) for item, no in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(sizes, pa.int64())], names=["item", "range_no", "n"])

    counted = ranges.mapInArrow(count, "item string, range_no int, n bigint")
    w = Window.partitionBy("item").orderBy("range_no")  # a number a range
    counted = counted.withColumn("char0", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n_chars", F.sum("n").over(Window.partitionBy("item")))
    reach = 4 * _reach(max_chars)

    def load(count: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    item, no = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                    at = no * range_bytes
                    halo = min(at, reach)
                    data = read(item, at - halo, halo + range_bytes + 16)
                    one = pa.record_batch(
                        [pa.array([item]), *(pa.array([x], t) for x, t in ((no, pa.int32()), (max_chars, pa.int32()), (overlap, pa.int32()), (b.column(3)[i].as_py(), pa.int64()), (b.column(4)[i].as_py(), pa.int64()), (data[:halo], pa.binary()), (data[halo : halo + range_bytes], pa.binary()), (data[halo + range_bytes :], pa.binary())))],
                        names=["item", "range_no", "max_chars", "overlap", "char0", "n_chars", "halo", "body", "ahead"],
                    )
                    yield from _pieces(iter([one]), count)

        return run

    placed = stage(counted.filter(F.col("n_chars") > max_chars), "places").repartition("item", "range_no")  # a row a range
    return _numbered(placed.mapInArrow(load(False), f"item string, {_PLACED}"), placed.mapInArrow(load(True), "item string, range_no int, n bigint"))
