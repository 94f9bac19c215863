import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from castplan.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH, public_tokenizers.PATTERN)


def expected(text):
    ids = np.array(REFERENCE.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op13_bpe(spark, sf).collect())
    assert got == sorted((r.doc_id, *expected(r.text)) for r in docs)


def test_merges_of_words(vocabulary):
    rng = random.Random(2)
    assert vocabulary.ranks == RANKS
    for k in range(600):
        word = "".join(rng.choices("abcde" if k % 2 else "thein é漢\U0001f600", k=rng.randrange(1, 60) if k % 5 else rng.randrange(200, 900)))
        want = REFERENCE._encode_single_piece(word.encode())
        assert bpe.merge(word.encode(), RANKS) == want
        if word.encode() not in RANKS:
            assert bpe._merge_long(word.encode(), RANKS) == want
    assert bpe.merge(b"ab" * 200_000, RANKS)  # not quadratic


def test_odd_white_space_and_letters(vocabulary):
    rng = random.Random(3)
    find, full = bpe.Finder(vocabulary.pattern), bpe.regex.compile(vocabulary.pattern)
    assert all(f is not find.full for f in find.plain) and bpe.plain_pattern(r"\p{Lu}", 127) is None
    every = "".join(chr(c) + "x" * (c % 3 == 0) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    assert list(find(every)) == full.findall(every) and list(find(every[:200])) == full.findall(every[:200])
    for k in range(3000):
        text = "".join(rng.choices("ab c\x1c\x1f\x85᠎ 　\xa0漢é's1½٣_-\n\t\r\x0b​￿힣Ⅷ\U0001f600̀ǅ"[:40 if k % 3 else 6], k=rng.randrange(1, 30)))
        assert [i for w in find(text) for i in bpe.merge(w.encode(), RANKS)] == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("block, placed", [(1 << 22, 1 << 19), (50, 7), (1, 1)])
def test_blocks_of_any_size(spark, hard_docs, vocabulary, monkeypatch, block, placed):
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", block)
    monkeypatch.setattr(bpe, "PLACED_TOKENS", placed)
    docs = (hard_docs if block > 60 else hard_docs.where("doc_id <> 6 OR doc_id IS NULL")).withColumn("N_TOKENS", F.lit("x")).withColumn("extra", F.array(F.lit(1)))
    out = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "ids", "n_tokens", "decoded"]
    rows = out.collect()
    assert sorted(((r.doc_id, r.text, r.lang, r.n_chars) for r in rows), key=repr) == sorted(((r.doc_id, r.text, r.lang, r.n_chars) for r in docs.collect()), key=repr)
    for r in rows:
        assert (r.n_tokens, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded).hexdigest()) == expected(r.text) and r.extra == [1]


def test_a_shuffled_input_and_a_hot_word(spark, vocabulary):
    rows = [(i, " the" * (i % 40) + f" w{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13, "doc_id")
    got = {r.doc_id: (r.n_tokens, hashlib.sha256(r.ids).hexdigest()) for r in bpe.encode(docs, vocabulary, keep=["doc_id"]).collect()}
    assert got == {i: expected(t)[:2] for i, t in rows}


def test_long_text(spark, vocabulary):
    text = "".join(f"word{i % 9973} {'é' * (i % 5)}\n" for i in range(400_000)) + "x" * 300_000
    row = bpe.decode(bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), vocabulary, keep=[]), vocabulary).first()
    assert bytes(row.decoded) == text.encode() and row.n_tokens == len(row.ids) // 4 == len(REFERENCE.encode_ordinary(text[:-300_000])) + len(bpe.merge(b"x" * 300_000, RANKS))


def test_empty_table_and_unknown_ids(spark, no_docs, vocabulary):
    assert bpe.decode(bpe.encode(no_docs, vocabulary), vocabulary).count() == 0
    odd = spark.createDataFrame([(1, bytearray(np.array([0, 60_000], "<u4").tobytes())), (2, None), (3, bytearray())], "k int, ids binary")
    assert [r.decoded for r in bpe.decode(odd, vocabulary).orderBy("k").collect()] == [None, None, bytearray()]
