import re

import pytest
from pyspark.sql import functions as F

from castplan.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(low(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i:i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(str(f) for f in found if f is not None)))
    return sorted(out, key=repr)


DOCS = [(1, "x " + " ".join(f"w{i}" for i in range(30)) + " y"), (2, "a W0, w1; w2-w3 w4 w5 w6 w7 w8 W9! tail"), (3, "tiny item here"), (4, None), (5, ""),
        (6, "TINY   item"), (7, "é1 straße x"), (8, "w0w1 w2"), (2, "a W0, w1; w2-w3 w4 w5 w6 w7 w8 W9! tail"), (None, "tiny item")]
ITEMS = [(10, " ".join(f"w{i}" for i in range(15))), (2, "Tiny item"), (3, ""), (4, None), (5, "straße"), (6, " ".join(f"w{i}" for i in range(9, 22))), (None, "x y"), (2, "Tiny item")]


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 60])
def test_scan_equals_brute_force(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.scan(docs, items, block_bytes=block).withColumn("n", D.span_words()).collect()
    assert sorted([(r.doc_id, r.n_words, r.n, list(r.hit_items)) for r in got], key=repr) == brute(DOCS, ITEMS)


def test_remove_documents_and_spans(spark):
    docs = spark.createDataFrame([(1, "before it Tiny, item after it"), (2, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(2, "tiny item")], "item_id long, text string")
    assert [r.doc_id for r in D.decontaminate(docs, items).collect()] == [2]
    cut = {r.doc_id: r.text for r in D.decontaminate(docs, items, remove="spans").collect()}
    assert cut == {1: "before it  after it", 2: "clean text"}


def test_empty_tables_and_clashes(spark, hard_docs, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    clash = hard_docs.withColumn("n_words", F.lit("x"))
    out = D.scan(clash, items)
    assert out.count() == hard_docs.count() and dict(out.dtypes)["n_words"] == "bigint" and out.where(F.size("hit_spans") > 0).count() == 0
    assert D.scan(no_docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert D.decontaminate(clash, items).columns == clash.columns
