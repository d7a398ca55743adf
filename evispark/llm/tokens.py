"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Texts are split into words in Spark; a word is what the vocabulary's own split pattern yields, so
merges never cross it. Words are counted with pre-aggregation per partition; every word that
stands at least twice is encoded once, in a distributed word table, and its ids are joined back by
position. A word that stands once in the corpus is encoded where it stands, which is also once: so
runs of text without spaces, nearly all of them unique, don't swell the table.
The join back is a broadcast look-up while the table is below a checked size. Beyond it documents go in groups of a bounded
size, the distinct words of each group are joined with the table, and each group meets its own part of it again, where ids are put
back by position: a word has one row a group, not one an occurrence, so frequent words are no hot keys.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.staging import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern of this vocabulary, white space written as a Unicode property.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
TABLE_BYTES = 64 * 2**20
_FLUSH = 200_000
#: A group of documents has about so many characters.
GROUP_CHARS = 8 * 2**20


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_ENCODERS: dict[int, object] = {}


def _encoder(vocabulary: bytes):
    """The vocabulary's encoder; one per worker process."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("public", pat_str=SPLIT.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def _splitter():
    import regex

    return regex.compile(SPLIT).findall


def _packed(encoder, word: str) -> bytes:
    return np.array(encoder.encode_ordinary(word), dtype="<i4").tobytes()


class _WordIds(dict):
    """word -> its ids as little-endian int32; words that aren't in the table are encoded here."""

    def __init__(self, words: dict[str, bytes], encoder) -> None:
        super().__init__(words)
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        return _packed(self.encoder, word)


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): every distinct word with its count; null and empty texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _splitter(), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.record_batch({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(split(text))
                    if len(seen) > _FLUSH:
                        yield out()
        yield out()

    return texts.select(text_col).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(texts: DataFrame, vocabulary: Broadcast, text_col: str = "text") -> DataFrame:
    """(word, ids binary): the words that stand at least twice in ``texts``, each encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            words = batch.column(0)
            yield pa.record_batch({"word": words, "ids": pa.array([_packed(encoder, w) for w in words.to_pylist()], pa.binary())})

    return word_counts(texts, text_col).filter("n >= 2").select("word").mapInArrow(encode, "word string, ids binary")


def _small_table(words: DataFrame, max_bytes: int) -> dict[str, bytes] | None:
    size = words.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("ids")), F.lit(0)).alias("n")).first()["n"]
    if size > max_bytes:
        return None
    table = words.toArrow()
    return dict(zip(table["word"].to_pylist(), table["ids"].to_pylist(), strict=True))


def _with_packed(docs: DataFrame, key: str, text_col: str, vocabulary: Broadcast, table_bytes: int, finish, schema: str) -> DataFrame:
    """``finish(key column, list of packed ids)`` for each row of (key, text)."""
    spark = docs.sparkSession
    words = stage(word_table(docs, vocabulary, text_col), "words")
    small = _small_table(words, table_bytes)
    if small is not None:
        shared = spark.sparkContext.broadcast(small)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            split, ids = _splitter(), _WordIds(shared.value, _encoder(vocabulary.value))
            for batch in batches:
                for at in range(0, batch.num_rows, 512):  # bounds the ids held at once
                    part = batch.slice(at, 512)
                    yield finish(part.column(0), [b"".join(map(ids.__getitem__, split(t))) if t else b"" for t in part.column(1).to_pylist()])

        return docs.select(key, text_col).mapInArrow(look_up, schema)

    return _by_groups(docs, key, text_col, words, vocabulary, finish, schema)


def _by_groups(docs: DataFrame, key: str, text_col: str, words: DataFrame, vocabulary: Broadcast, finish, schema: str) -> DataFrame:
    """The shuffled form of the look-up: groups of documents with the part of the table that their words need."""
    chars = docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-chars // GROUP_CHARS))
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    grouped = stage(docs.select(group.alias("_group"), F.col(key).alias("_key"), F.col(text_col).alias("_text")), "groups")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, now = _splitter(), set(), None

        def out(group: int) -> pa.RecordBatch:
            batch = pa.record_batch({"_group": pa.array([group] * len(seen), pa.int32()), "word": pa.array(seen, pa.string())})
            seen.clear()
            return batch

        for batch in batches:
            for group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seen and (group != now or len(seen) > _FLUSH):
                    yield out(now)
                now = group
                if text:
                    seen.update(split(text))
        if seen:
            yield out(now)

    parts = grouped.select("_group", "_text").repartition("_group").sortWithinPartitions("_group").mapInArrow(distinct, "_group int, word string").join(words, "word")

    def meet(texts: pa.Table, part: pa.Table) -> pa.Table:
        split, ids = _splitter(), _WordIds(dict(zip(part["word"].to_pylist(), part["ids"].to_pylist(), strict=True)), _encoder(vocabulary.value))
        packed = [b"".join(map(ids.__getitem__, split(t))) if t else b"" for t in texts["_text"].to_pylist()]
        return pa.Table.from_batches([finish(texts["_key"].combine_chunks(), packed)])

    return grouped.groupBy("_group").cogroup(parts.groupBy("_group")).applyInArrow(meet, schema)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text_col: str = "text", vocabulary: bytes | None = None, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(key, ids array<int>): the token ids of each text, without special tokens.

    Null and empty texts give an empty list; text that looks like a special token is ordinary text.
    One row for each row of ``docs`` (its keys are unique); other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    def finish(keys: pa.Array, packed: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(b) // 4 for b in packed)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
        return pa.record_batch([keys, ids], names=[key, "ids"])

    return _with_packed(docs, key, text_col, shared, table_bytes, finish, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text_col: str = "text", vocabulary: bytes | None = None, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(key, n_tokens bigint): the number of ids :func:`encode_corpus` gives."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    def finish(keys: pa.Array, packed: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([keys, pa.array([len(b) // 4 for b in packed], pa.int64())], names=[key, "n_tokens"])

    return _with_packed(docs, key, text_col, shared, table_bytes, finish, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint")


def pieces(vocabulary: bytes | None = None) -> list[bytes]:
    """The bytes of each id; ids that the vocabulary lacks have none. The table's size is fixed by the vocabulary."""
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, (vocabulary or read_vocabulary()).splitlines())}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def decode_corpus(encoded: DataFrame, key: str = "doc_id", vocabulary: bytes | None = None) -> DataFrame:
    """(key, text): the texts of (key, ids); a null or empty list gives ''.

    The ids of a batch are joined with the table of pieces by position, where they lie: the table is small and of fixed size, so nothing is
    shuffled. Ids outside the vocabulary give nothing; bytes that are no UTF-8 become the replacement character.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                known = (ids >= 0) & (ids < len(table)) if ids.size else np.zeros(0, dtype=bool)
                found = table.take(pa.array(np.where(known, ids, 0).astype(np.int32)))
                ends = np.concatenate([[0], np.cumsum(np.where(known, pc.binary_length(found).to_numpy(zero_copy_only=False), 0))]) if ids.size else np.zeros(1, dtype=np.int64)
                joined = b"".join(x for x, ok in zip(found.to_pylist(), known, strict=True) if ok)
                stops = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                yield pa.record_batch([part.column(0), pa.array([joined[ends[a] : ends[b]].decode("utf-8", "replace") for a, b in zip(stops[:-1], stops[1:], strict=True)], pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_tokens, same): whether decoding the ids gives the text back (null counts as empty). Only digests are joined."""
    digest = lambda c: F.md5(F.encode(c, "utf-8"))
    encoded = stage(encode_corpus(docs, key, text_col), "ids")
    decoded = decode_corpus(encoded, key).select(key, digest("text").alias("decoded"))
    sizes = encoded.select(key, F.size("ids").alias("n_tokens"))
    before = docs.select(key, digest(F.coalesce(F.col(text_col), F.lit(""))).alias("given"))
    return before.join(decoded, key).join(sizes, key).select(key, "n_tokens", (F.col("given") == F.col("decoded")).alias("same"))
