import base64

import pytest
import tiktoken
from tokenizers import Tokenizer

from evispark.llm import tokens as T

DOCS = "doc_id bigint, text string, word string, ids string, n int"
TEXTS = [
    "The model's loss  isn't\n\nlow: it'll grow 12345 times.", "", None, " ", "\t\n  x", "<|endoftext|> is text", "没有空格的句子。 ok", "a b　c\x1cd​e", "😀👩‍🔬 é ﬁ", "The model's loss  isn't\n\nlow", "x" * 300, "१२३ ⅷ Ωß", "\r\n\r\n a",
]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in enumerate(texts)], DOCS)


def reference():
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("table_bytes", [T.TABLE_BYTES, 0])
def test_ids_are_the_tokenizers(spark, table_bytes):
    got = {r.doc_id: r.ids for r in T.encode_corpus(docs(spark), table_bytes=table_bytes).collect()}
    t = reference()
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in T.token_counts(docs(spark), table_bytes=table_bytes).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_round_trip(spark):
    assert all(r.same for r in T.round_trip(docs(spark)).collect())


def test_decoding_of_odd_ids(spark):
    rows = spark.createDataFrame([(1, [40, -1, 99999, 257]), (2, None), (3, []), (4, [50255, 40])], "doc_id bigint, ids array<int>")
    p = T.pieces()
    assert {r.doc_id: r.text for r in T.decode_corpus(rows).collect()} == {1: (p[40] + p[257]).decode(), 2: "", 3: "", 4: (p[50255] + p[40]).decode()}


def test_other_vocabulary(spark):
    data = T.read_vocabulary("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    enc = tiktoken.Encoding("t", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in T.encode_corpus(docs(spark), vocabulary=data).collect()}
    assert got[0] == enc.encode_ordinary(TEXTS[0]) and got[6] == enc.encode_ordinary(TEXTS[6])


def test_no_documents(spark):
    assert T.encode_corpus(spark.createDataFrame([], DOCS)).count() == 0
    assert T.encode_corpus(spark.createDataFrame([], DOCS), table_bytes=-1).count() == 0


def test_each_word_that_comes_again_is_in_the_table_once(spark):
    words = T.word_table(docs(spark, ["a b a", "x b c"]), spark.sparkContext.broadcast(T.read_vocabulary())).collect()
    assert [w.word for w in words] == [" b"]


def test_very_long_text(spark):
    text = "many words in one text, " * 40_000
    assert T.token_counts(docs(spark, [text])).first()["n_tokens"] == len(reference().encode(text, add_special_tokens=False).ids)
