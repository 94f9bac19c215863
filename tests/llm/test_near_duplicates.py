import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from castplan.llm import bbit_minhash as M
from castplan.llm import textwords as tw
from castplan.llm.components import connected_components
from castplan.llm.queries import QUERIES


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, pct):
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= pct * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.fixture(scope="module")
def near_copies():
    """One hot group of edited copies (hub and chains), exact copies, and unrelated texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    hub = [rng.choice(vocabulary) for _ in range(90)]
    rows = [(0, " ".join(hub)), (1, " ".join(hub).upper().replace("W", "w"))]
    for i in range(2, 160):
        own = list(hub)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            own[rng.randrange(90)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 30, 60])))) for i in range(160, 220)]
    rows += [(220, "a b"), (221, "A  b"), (222, ""), (223, "")]
    return rows


@pytest.mark.parametrize("block", [M.BLOCK_SHINGLES, 800])
def test_components_equal_all_pairs(spark, near_copies, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_SHINGLES", block)  # 800: many blocks and block pairs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(near_copies, "doc_id long, text string"), 4, 80).collect()}
    assert got == brute(near_copies, 4, 80)


def test_estimate_is_close_and_floor_is_safe():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        common = rng.integers(0, 2 ** 63, 600, dtype=np.uint64)
        extra = int(600 * (1 - share) / share / 2)
        sets = [np.sort(np.concatenate([common, rng.integers(0, 2 ** 63, extra, dtype=np.uint64)])) for _ in range(2)]
        true = 600 / (600 + 2 * extra)
        packed = M.pack(np.array([M.minima(s) for s in sets]))
        assert abs(float(M.estimate(packed[0], packed[1])) - true) < 0.15
    assert M.estimate_floor(0.8) < 0.68


def test_band_recall_at_threshold():
    assert (1 - 0.8 ** M.ROWS) ** M.BANDS < 1e-6


def test_hard_rows(spark, hard_docs):
    out = M.near_duplicates(hard_docs, 5, 80).collect()
    assert len(out) == hard_docs.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by[1] == {(1, True)} and by[2] == {(1, False)}
    assert by[3] == {(3, True)} and by[4] == {(4, True)} and by[5] == {(5, True)} and by[9] == {(9, True)}
    assert (1, False) in by[None] and (None, True) in by[None]
    kept = M.deduplicate(hard_docs, 5, 80)
    assert kept.columns == hard_docs.columns and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id = 8").count() == 2


def test_empty_and_clashing(spark, no_docs, hard_docs):
    assert M.near_duplicates(no_docs).count() == 0
    clash = hard_docs.withColumn("kept", F.lit("x")).withColumn("component_id", F.lit("y"))
    assert dict(M.annotate(clash).dtypes)["kept"] == "boolean"
    assert M.deduplicate(clash).columns == clash.columns


def test_connected_components_chain_and_star(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 5), (7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_query_is_whole(spark):
    df = QUERIES["op6_bbit_minhash"](spark, "/root/testdata/sf0.001")
    assert df.count() == 200 and df.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_word_hashes_match_python_words():
    texts = ["a b  c", "", "Ab\tÉé x\x0by", "z"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    starts, ends, first = tw.words(data, offsets, tw.SPACE_WORDS)
    assert [data[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)] == ["a", "b", "c", "Ab", "Éé", "x", "y", "z"]
    assert list(first) == [0, 3, 3, 7, 8]
