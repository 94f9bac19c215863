import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from castplan.llm import order_minhash as O


def brute(spark, texts):
    """The same sketches with plain Python lists (Spark only lends xxhash64)."""
    words = [[w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ")] if (t or "").strip() else [] for t in texts]

    def hashed(rows, schema, *cols):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        return [r[0] for r in df.select(F.xxhash64(*cols).alias("h"), "i").orderBy("i").collect()]
    flat = [w for ws in words for w in ws]
    hs = iter(hashed([(w,) for w in flat], "i int, w string", "w"))
    words = [[next(hs) for _ in ws] for ws in words]
    grams = [[(ws + [None] * 2)[i:i + 3] for i in range(len(ws))] for ws in words]
    ks = iter(hashed([tuple(g) for gs in grams for g in gs], "i int, a long, b long, c long", "a", "b", "c"))
    out = []
    for gs in grams:
        kmers = [(next(ks) % (1 << 64)) >> 25 for _ in gs]
        seen, todo = collections.Counter(), []
        for k in kmers:
            todo.append((k, seen[k]))
            seen[k] += 1
        again = [x for x in todo if x[1]]
        new = dict(zip(again, hashed(again, "i int, k long, n int", "k", "n"), strict=True)) if again else {}
        numbered = [((new[x] % (1 << 64)) >> 25 if x[1] else x[0], p) for p, x in enumerate(todo)]
        parts = collections.defaultdict(list)
        for h, p in sorted(numbered):
            parts[h >> 33].append((p, h))
        pairs = [(part, [h for _, h in sorted(own[:2])]) for part, own in sorted(parts.items())]
        one, two = [p for p in pairs if len(p[1]) == 1], [p for p in pairs if len(p[1]) == 2]
        got = dict(zip([p[0] for p in one], hashed([tuple(p[1]) for p in one], "i int, a long", "a"), strict=True)) if one else {}
        if two:
            got |= dict(zip([p[0] for p in two], hashed([tuple(p[1]) for p in two], "i int, a long, b long", "a", "b"), strict=True))
        out.append([part << 32 | (got[part] % (1 << 64)) >> 32 for part, _ in pairs])
    return out


def test_sketches_equal_plain_python(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(n)) for n in (1, 2, 3, 40, 400)]
    texts += ["go go go go go go go go go", "", None, " \n", "é ß\t漢字"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r.s for r in df.select("i", O.sketches(F.col("text")).alias("s")).orderBy("i").collect()]
    assert got == brute(spark, texts)


def likeness(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(O.likeness(O.sketches(F.col("a")), O.sketches(F.col("b")))).first()[0]


def test_likeness_follows_edits_and_order(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(600)]
    text = " ".join(words)
    light = " ".join([*words[:300], "x", *words[301:]])
    moved = " ".join(words[i] for b in range(59, -1, -1) for i in range(b * 10, b * 10 + 10))
    assert likeness(spark, text, text) == 1.0 and likeness(spark, text, light) > 0.8
    assert likeness(spark, text, moved) < 0.75 * likeness(spark, text, light)  # same blocks, other order
    assert likeness(spark, text, "nothing alike") == 0.0 and likeness(spark, "", None) == 1.0 and likeness(spark, "", text) == 0.0


@pytest.mark.parametrize("per_slice", [2000, 7])
def test_edit_report_next_in_descending_order(spark, per_slice, monkeypatch):
    monkeypatch.setitem(O.with_next.__kwdefaults__ or {}, "x", 0)
    monkeypatch.setattr(O.with_next, "__defaults__", (per_slice,))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in O.edit_report(docs).collect()}
    prints = {}
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)]
        third = len(t) // 3
        edited = t[:len(t) - third] + nxt[1][:third]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints.setdefault(t, set()).add(got[d].fingerprint)
        if edited == t:
            assert got[d].near_edited == 1.0
    assert len(got) == len(rows) and all(len(p) == 1 for p in prints.values())


def test_hard_rows(spark, hard_docs, no_docs):
    out = O.edit_report(hard_docs).collect()
    assert len(out) == hard_docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert {r.fingerprint for r in out if r.doc_id in (3, 4, 5, 9)} == {""}
    assert O.edit_report(no_docs).count() == 0 and O.edit_report(hard_docs.where("doc_id = 6")).first().near_next == 1.0
    added = O.add_fingerprint(hard_docs.withColumn("Fingerprint", F.lit(1)))
    assert added.columns.count("fingerprint") == 1 and added.count() == hard_docs.count()
