import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from castplan.llm import kd_sharding as K
from castplan.llm import length_packing as P
from castplan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def dims():
    return [K.log_ordinal(F.octet_length("text")), K.text_ordinal(F.col("source")), K.text_ordinal(F.col("lang"))]


def brute_tree(rows, shards):
    """The same recursion over sorted lists: rows are (size, ordinals, tie)."""
    whole = [max(1, max(r[1][i] for r in rows) - min(r[1][i] for r in rows)) for i in range(3)]

    def split(part, k):
        if k == 1 or not part:
            return [sum(r[0] for r in part)] + [0] * (k - 1)
        width = [max(r[1][i] for r in part) - min(r[1][i] for r in part) for i in range(3)]
        dim = max(range(3), key=lambda i: (width[i] / whole[i], -i))
        part = sorted(part, key=lambda r: (r[1][dim], r[2]))
        goal, upto, cut = sum(r[0] for r in part) * (k // 2) / k, 0, 0
        for cut, r in enumerate(part):
            if upto + r[0] >= int(goal):
                break
            upto += r[0]
        if upto + part[cut][0] - int(goal) <= int(goal) - upto:
            cut += 1
        return split(part[:cut], k // 2) + split(part[cut:], k - k // 2)
    return split(rows, shards)


@pytest.mark.parametrize("shards", [16, 5])
def test_tree_equals_sorted_recursion(spark, shards, monkeypatch):
    monkeypatch.setattr(K, "TOLERANCE", 0.0)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    narrow = docs.select((F.octet_length("text") + 1).alias("size"), *dims(), F.shiftrightunsigned(F.xxhash64("doc_id", crc), 33)).collect()
    want = brute_tree([(r[0], tuple(r[1:4]), r[4]) for r in narrow], shards)
    out = K.kd_shards(docs, dims(), shards=shards).collect()
    got = collections.Counter()
    for r in out:
        got[r.shard] += r.size
    assert [got[s] for s in range(shards)] == want


def test_shards_are_even_gapless_and_whole(spark):
    out = QUERIES["op2_kd_sharding"](spark, "/root/testdata/sf0.01").collect()
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(out) == 1000 and set(size) == set(range(16)) and max(size.values()) - min(size.values()) <= max(r.size for r in out)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_hot_value_is_divided(spark):
    rows = [(i, "x" * (1 + i % 5), "hot" if i % 3 else f"s{i}", "en") for i in range(600)]
    out = K.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), dims(), shards=8)
    sizes = [r["sum(size)"] for r in out.groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) < 1.15 * min(sizes)


def test_target_bytes_hard_rows_and_empty(spark, hard_docs, no_docs):
    clash = hard_docs.withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1))
    out = K.kd_shards(clash, dims(), target_bytes=100_000)
    assert out.count() == hard_docs.count() and out.where("shard IS NULL OR slot IS NULL").count() == 0
    assert K.kd_shards(no_docs, dims(), shards=16).count() == 0


def test_edges_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        n, k = rng.randint(1, 9), rng.randint(1, 5)
        lengths, counts = np.array(sorted(rng.sample(range(1, 60), n))), np.array([rng.randint(1, 9) for _ in range(n)])

        def padding(edges, lengths=lengths, counts=counts):
            return sum(int(c) * (min(e for e in edges if e >= x) - int(x)) for x, c in zip(lengths, counts, strict=True))
        got = P.choose_edges(lengths, counts, k)
        assert len(got) == min(k, n)
        assert padding(got) == min(padding({*s, int(lengths[-1])}) for s in itertools.combinations(map(int, lengths), min(k, n) - 1))


def test_packing_is_whole_and_within_budget(spark, hard_docs):
    out = P.pack(hard_docs.withColumn("bucket", F.lit("x")), buckets=3, max_length=50, token_budget=400).collect()
    by = collections.defaultdict(list)
    for r in out:
        if r.piece is not None:
            by[r.bucket, r.batch].append(r)
            assert 0 < r.piece_tokens <= r.bucket_length <= 50 and r.padding == r.bucket_length - r.piece_tokens
    for (_, _), rows in by.items():
        assert len(rows) * rows[0].bucket_length <= 400 and sorted(r.batch_slot for r in rows) == list(range(len(rows)))
    long = [r for r in out if r.doc_id == 6]
    assert sorted(r.piece for r in long) == list(range(1200)) and sum(r.piece_tokens for r in long) == 60_000
    assert sum(1 for r in out if r.piece is None) == sum(1 for r in hard_docs.collect() if not (r.text or "").strip())


def test_packing_numbers_every_slice(spark, monkeypatch):
    from castplan.llm import shared
    monkeypatch.setattr(shared.slices_for, "__defaults__", (7,))
    rows = spark.range(200).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 4 AS int)) AS text")
    out = P.pack(rows, buckets=2, max_length=8, token_budget=16).collect()
    batches = collections.Counter((r.bucket, r.batch) for r in out)
    full = collections.defaultdict(list)
    for (b, n), c in batches.items():
        full[b].append((n, c))
    for b, own in full.items():
        room = 16 // [r.bucket_length for r in out if r.bucket == b][0]
        assert all(c == room for n, c in sorted(own)[:-1]) and [n for n, _ in sorted(own)] == list(range(len(own)))


def test_packing_empty(spark, no_docs):
    assert P.pack(no_docs).count() == 0
    blank = spark.createDataFrame([(1, " "), (2, None)], "doc_id long, text string")
    assert [(r.n_tokens, r.bucket, r.batch) for r in P.pack(blank).collect()] == [(0, None, None)] * 2


def test_word_count_expression(spark):
    rows = [("a b", 2), ("  a\tb\nc ", 3), ("", 0), (None, 0), ("é x", 1)]
    got = spark.createDataFrame(rows, "text string, n int").select(P.count_words(), "n").collect()
    assert all(r[0] == r[1] for r in got)
