import corpus_pipeline as P
from .test_line_dedup import brute as brute_lines
from .test_near_duplicates import brute as brute_near
from .test_decontamination import brute as brute_benchmark

from castplan.llm import length_packing, quality_qda

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    good = {r.doc_id for r in quality_qda.score(docs, labels, keep=["doc_id"]).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    cut = brute_lines(rows)
    rows = [(d, cut[d][0]) for d, t in rows if not cut[d][1] or cut[d][0].strip() and len(cut[d][0].encode()) > 0.4 * len(t.encode())]
    group = brute_near(rows, 5, 80)
    rows = [(d, t) for d, t in rows if group[d][1] == d]
    hits = {d: n for d, _, n, _ in brute_benchmark(rows, [(r.item_id, r.text) for r in bench.collect()])}
    rows = {d: len(t.split()) for d, t in rows if not hits[d]}
    out = P.run(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in out} == rows and len(rows) < 200
    lengths = sorted({r.piece_tokens for r in out if r.piece_tokens})
    import numpy as np
    counts = [sum(1 for r in out if r.piece_tokens == n) for n in lengths]
    edges = length_packing.choose_edges(np.array(lengths), np.array(counts), 12)
    assert all(r.bucket_length == min(e for e in edges if e >= r.piece_tokens) for r in out if r.piece_tokens)


def test_stages_keep_columns_and_take_hard_rows(spark, hard_docs, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    for name, stage in P.STAGES:
        for docs in (hard_docs, hard_docs.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= 3000 and (name == "packing" or out.columns == docs.columns)


def test_of_planted_copies_one_document_stays(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # later copies of every document change nothing
    copies = [docs.withColumn("doc_id", docs.doc_id + at) for at in (1_000_000, 2_000_000)]
    docs.unionByName(copies[0]).unionByName(copies[1]).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    alone, out = ({(r.doc_id, r.n_tokens) for r in P.run(spark, d).collect()} for d in (SF, str(tmp_path)))
    assert out == alone and len(alone) > 50


def test_of_planted_near_copies_one_document_stays(spark, tmp_path):
    """Copies with one line changed: what is left of them without the original's lines goes too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = [r for r in docs.collect() if r.text and 8 <= len(r.text.split("\n")) and len(r.text.split()) > 120]
    copies = []
    for r in whole[:40]:
        lines = r.text.split("\n")
        lines[3] = "a line of other words stands here in this copy alone, number " + str(r.doc_id)
        copies.append((r.doc_id + 1_000_000, "\n".join(lines), r.lang, r.source, r.n_chars))
    docs.unionByName(spark.createDataFrame(copies, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    out = {r.doc_id for r in P.run(spark, str(tmp_path)).collect()}
    assert len(whole) >= 20 and len({d for d in out if d >= 1_000_000}) <= 0.05 * len(copies) and len(out) > 50
