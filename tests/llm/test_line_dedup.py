import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from castplan.llm import line_dedup as L
from castplan.llm import textwords as tw


def hash_of(line):
    data = np.frombuffer(line, np.uint8)
    return int(tw.span_hash(tw.prefix_hash(data), np.array([0]), np.array([len(data)]))[0])


def mixed(x):
    return int(tw.mix(np.array([x % 2 ** 64], np.uint64))[0])


def chunks_of(text, long_words=32, least=10, most=50):
    """The chunks by the rule as it is written, line by line: ``(number, first byte, end byte, bytes)``."""
    raw = text.encode()
    lines, pos = [], 0
    for line in raw.split(b"\n"):
        lines.append((pos, pos + len(line), line))
        pos += len(line) + 1
    if raw.endswith(b"\n") or not raw:
        lines.pop()
    filled = [(a, b, line, len(re.findall(rb"[^\x20\x09-\x0d]+", line))) for a, b, line in lines]
    filled = [x for x in filled if x[3]]
    step = 0xD1342543DE82EF95
    spans = set()
    for i in range(len(filled)):
        for way in (1, -1):
            j, chunk = i, [filled[i]]
            while True:
                words = sum(x[3] for x in chunk)
                enough = words >= least and (len(chunk) > 1 or chunk[0][3] >= long_words or False)
                enough = enough or words >= least and any(x[3] >= long_words for x in chunk)
                if enough:
                    if len(chunk) == 1:
                        even = mixed(hash_of(chunk[0][2])) % 2 == 0
                    else:
                        p, q = chunk[-2:] if way > 0 else chunk[:2]
                        even = mixed(hash_of(q[2]) + hash_of(p[2]) * step) % 2 == 0
                    if even == (way > 0) or words >= most:
                        break
                j += way
                if not 0 <= j < len(filled):
                    break
                chunk = [*chunk, filled[j]] if way > 0 else [filled[j], *chunk]
            if enough:
                spans.add((chunk[0][0], chunk[-1][1]))
    return [(n, a, min(b + 1, len(raw)), raw[a:b]) for n, (a, b) in enumerate(sorted(spans))]


def brute(rows):
    """Texts without the later occurrences of every chunk, by plain dictionaries."""
    places = collections.defaultdict(list)
    for d, t in sorted(rows):
        for n, a, b, body in chunks_of(t):
            places[body].append((d, n, a, b))
    cut = collections.defaultdict(list)
    for found in places.values():
        for d, n, a, b in sorted(found)[1:]:
            cut[d].append((a, b))
    out = {}
    for d, t in rows:
        raw, pos, parts = t.encode(), 0, []
        for a, b in sorted(cut[d]):
            if b > pos:
                parts.append(raw[pos:max(a, pos)])
                pos = b
        out[d] = (b"".join([*parts, raw[pos:]]).decode(), len(cut[d]))
    return out


def test_against_brute_force(spark):
    rng = random.Random(9)
    lines = [" ".join(f"l{i}w{j}" for j in range(rng.choice([4, 8, 40]))) for i in range(60)]
    passage = lines[:9]
    rows = []
    for d in range(120):
        own = [" ".join(f"d{d}x{rng.random():.6f}" for _ in range(rng.choice([3, 9, 45]))) for _ in range(rng.randrange(1, 9))]
        if d % 3 == 0:
            own[rng.randrange(len(own)):0] = passage  # the same lines, shifted by what stands before
        rows.append((d, "\n".join(own) + ("\n" if d % 7 == 0 else "")))
    got = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert sum(n for _, n in want.values()) > 30
    for d, (text, n) in want.items():
        assert got[d].text.rstrip("\n") == text.rstrip("\n") and got[d].n_removed_chunks == n


def test_chunk_table_is_the_rule_as_written():
    rng = random.Random(8)
    for _ in range(300):
        texts = ["\n".join(rng.choice(["", " ", "a", "one two three", "x " * rng.randrange(1, 60)]) + str(rng.randrange(9)) * rng.randrange(2)
                           for _ in range(rng.randrange(0, 14))) + rng.choice(["", "\n"]) for _ in range(3)]
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        doc, start, stop, number, _, _ = L.chunk_table(np.frombuffer(b"".join(raw), np.uint8), offsets)
        for d, t in enumerate(texts):
            own = doc == d
            assert list(zip(number[own], start[own] - offsets[d], stop[own] - offsets[d], strict=True)) == [(n, a, b) for n, a, b, _ in chunks_of(t)], t


def test_boundaries_are_shift_resistant():
    """The chunks inside a passage don't change with the lines around it, and most chunks end at a boundary."""
    rng = random.Random(10)
    passage = [" ".join(f"p{i}w{j}" for j in range(rng.choice([4, 9, 14]))) for i in range(40)]
    inside = []
    for shift in range(6):
        around = [" ".join(f"s{shift}x{i}y{j}" for j in range(7)) for i in range(shift)]
        text = "\n".join([*around, *passage, *around])
        body = "\n".join(passage)
        lo = text.index(body)
        inside.append({c[3] for c in chunks_of(text) if lo <= c[1] and c[2] <= lo + len(body) + 1})
    common = set.intersection(*inside)
    assert len(common) > 60 and all(len(x - common) <= 8 for x in inside)
    words = [len(c.split()) for c in common]
    assert sum(w < 50 for w in words) > 0.8 * len(words) and len({c.count(b"\n") for c in common}) > 2


def test_long_repeated_line_is_removed_once_kept(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(d, f"intro {d} text\n{passage}\nouttro {d} words") for d in range(6)] + [(9, passage)]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in got[0] and not any(passage in got[d] for d in (1, 2, 3, 4, 5, 9)) and got[9] == ""
    assert got[3] == "intro 3 text\nouttro 3 words"


def test_clean_short_lines_stay(spark):
    rows = [(d, f"Yes.\nOk.\nunique {d} line of words") for d in range(5)]
    assert {r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {t for _, t in rows}


def test_both_ways_of_filtering_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = sorted((r.doc_id, r.text) for r in L.dedup_lines(docs).collect())
    monkeypatch.setattr(L, "BROADCAST_HASHES", 0)
    assert one == sorted((r.doc_id, r.text) for r in L.dedup_lines(docs).collect())


def test_hard_rows(spark, hard_docs, no_docs):
    clash = hard_docs.withColumn("N_LINES", F.lit("x")).withColumn("extra", F.lit(1))
    out = L.dedup_lines(clash)
    assert out.count() == hard_docs.count() and [c for c in out.columns if c.lower() == "n_lines"] == ["n_lines"]
    rows = out.collect()
    assert any(r.doc_id == 3 and r.text is None for r in rows) and any(r.doc_id == 4 and r.text == "" for r in rows)
    assert [r.n_lines for r in rows if r.doc_id == 9] == [3]
    assert L.dedup_lines(no_docs).count() == 0


def test_planted_passages_of_short_lines_go_whole(spark):
    """Expected texts are put together from the hosts' own lines, without ``chunk_table``."""
    rng = random.Random(5)
    rows, want = [], {}
    for p in range(140):
        n = 2 + p % 7
        total = rng.randrange(max(51, 4 * n), min(100, 31 * n) + 1)
        sizes = [total // n + (i < total % n) for i in range(n)]
        passage = [" ".join(f"p{p}l{i}w{j}" for j in range(size)) for i, size in enumerate(sizes)]
        assert max(sizes) < L.LONG_WORDS and total > 50
        for copy in range(3):
            d = copy * 1000 + p
            around = [[" ".join(f"d{d}{side}{i}x{j}" for j in range(rng.choice([2, 9, 17, 40]))) for i in range(rng.randrange(4))] for side in "ab"]
            rows.append((d, "\n".join([*around[0], *passage, *around[1]])))
            want[d] = "\n".join([*around[0], *(passage if copy == 0 else []), *around[1]])
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: t for d, (t, _) in got.items()} == want
    assert all(n == (0 if d < 1000 else 2 + d % 1000 % 7) for d, (_, n) in got.items())


def test_lone_repeated_lines_stay_and_every_line_stays_once(spark):
    rng = random.Random(6)
    common = "one line of twelve words that stands in every text of these"
    lone = [(d, f"own{d} first line\n{common}\nown{d} last line") for d in range(4)]
    assert {r.text for r in L.dedup_lines(spark.createDataFrame(lone, "doc_id long, text string")).collect()} == {t for _, t in lone}
    lines = [" ".join(f"l{i}w{j}" for j in range(rng.choice([1, 6, 12, 40]))) for i in range(12)] + ["", " "]
    rows = [(d, "\n".join(rng.choices(lines, k=rng.randrange(1, 12)))) for d in range(80)]
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept, there = ({x for t in texts for x in t.split("\n") if x.strip()} for texts in ([r.text for r in out], [t for _, t in rows]))
    assert kept == there and sum(r.n_removed_lines for r in out) > 100
    copies = [(d, "\n \nshort line here\n\nand a second one of eight words now\n") for d in range(3)]
    assert [r.text.strip() != "" for r in L.dedup_lines(spark.createDataFrame(copies, "doc_id long, text string")).orderBy("doc_id").collect()] == [True, False, False]
