import numpy as np
from pyspark.sql import functions as F

from castplan.llm import pseudo_likelihood as L
from castplan.llm import quality_qda as Q
from castplan.llm import textwords as tw
from castplan.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = {r.doc_id: r for r in QUERIES["op3_quality_qda"](spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if out[r.doc_id].held_out]
    assert len(out) == 1000 and len(labels) > 40
    assert np.mean([out[r.doc_id].predicted == r.quality for r in labels]) >= 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out.values())


def test_score_ignores_labels_held_out_and_metadata(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(Q.training_row(), F.col("quality")).otherwise(1 - F.col("quality")))
    a = sorted(Q.score(docs, labels, keep=["doc_id"]).collect())
    b = sorted(Q.score(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), flipped, keep=["doc_id"]).collect())
    assert np.allclose([r.score for r in a], [r.score for r in b], atol=1e-9)


def test_difference_equals_plain_density():
    rng = np.random.default_rng(0)
    k = len(Q.STATISTICS)
    covs = [np.diag(rng.uniform(0.5, 2, k)), np.eye(k) + 0.1]
    means = [rng.normal(size=k), rng.normal(size=k)]
    model = Q.Model(0.5, means, [np.linalg.cholesky(c) for c in covs])
    x = rng.normal(size=(5, k))

    def density(v, m, c):
        return -0.5 * (v - m) @ np.linalg.inv(c) @ (v - m) - 0.5 * np.log(np.linalg.det(c))
    assert np.allclose(model.difference(x), [density(v, means[1], covs[1]) - density(v, means[0], covs[0]) for v in x])


def test_statistics_are_per_text():
    texts = ["Hello WORLD!! 12", "", "a a a b | c", "éß"]
    raw = [t.encode() for t in texts]

    def of(rs):
        return Q.statistics(np.frombuffer(b"".join(rs), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rs])]))
    assert np.allclose(of(raw), np.vstack([of([r]) for r in raw]))
    assert of(raw)[2][Q.STATISTICS.index("distinct")] ** 2 == 4 / 6


def test_quality_hard_rows(spark, hard_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (7, 5), (6, 1), (8, 0), (8, 0), (11, 0)], "doc_id long, quality int")
    out = Q.score(hard_docs.withColumn("SCORE", F.lit("x")), labels)
    assert out.count() == hard_docs.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert Q.score(hard_docs, labels.where("false")).select("score").distinct().collect()[0][0] == 0.5
    assert Q.score(no_docs, labels).count() == 0
    assert Q.keep_quality(hard_docs, labels).columns == hard_docs.columns


def test_network_probabilities_sum_to_one_and_gradient_is_right():
    net = L.Network()
    rng = np.random.default_rng(2)
    for k in ("c", "t"):
        net.w[k] += rng.normal(0, 0.3, net.w[k].shape).astype(np.float32)
    context = rng.integers(0, L.TOKENS + 1, (1, 2 * L.SIDE))
    total = np.exp(net.log_probabilities(context.repeat(L.TOKENS, 0), np.arange(L.TOKENS))).sum()
    assert abs(total - 1) < 1e-4
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rows, tokens = rng.integers(0, L.TOKENS, (6, 2 * L.SIDE)), rng.integers(0, L.TOKENS, 6)
    g = net.gradients(rows, tokens)
    for k in ("h", "cb", "tb"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        values = []
        for step in (1e-4, -1e-4):
            net.w[k][at] += step
            values.append(-net.log_probabilities(rows, tokens).mean())
            net.w[k][at] -= step
        assert abs((values[0] - values[1]) / 2e-4 - g[k][at]) < 1e-4


def brute_score(net, vocab, text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    hashes = tw.word_hashes(raw, np.array([0, len(raw)]), tw.SPACE_WORDS)[0]
    t = [int(x) for x in vocab.tokens_of(hashes)]
    total = 0.0
    for i in range(len(t)):
        context = [t[j] if 0 <= j < len(t) else L.BORDER for j in (i - 2, i - 1, i + 1, i + 2)]
        total += float(net.log_probabilities(np.array([context]), np.array([t[i]]))[0])
    return len(t), total


def test_scores_equal_word_by_word(spark, hard_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net, vocab = L.train(docs)
    out = {r.doc_id: r for r in L.score(docs, model=(net, vocab)).collect()}
    for r in docs.limit(12).collect():
        n, total = brute_score(net, vocab, r.text)
        assert out[r.doc_id].n_words == n and abs(out[r.doc_id].log_likelihood - total) < 1e-2 + 1e-4 * abs(total)
    hard = L.score(hard_docs.withColumn("n_words", F.lit("x")), model=(net, vocab)).collect()
    assert len(hard) == hard_docs.count() and all((r.mean_log_likelihood is None) == (r.n_words == 0) for r in hard)


def test_training_beats_frequencies_and_uses_more_with_more(spark, monkeypatch, no_docs):
    monkeypatch.setattr(L, "WINDOWS_PER_MILLION", 400_000)
    text = " ".join("alpha beta gamma delta" for _ in range(60))
    docs = spark.createDataFrame([(i, text) for i in range(4)] + [(9, "other words")], "doc_id long, text string")
    monkeypatch.setattr(L, "SHARD_WINDOWS", 60)
    monkeypatch.setattr(L, "FAN_IN", 2)  # a tree of sums
    net, vocab = L.train(docs)
    start = L.Network()
    L.unigram_start(start, vocab.counts)
    better, plain = (sum(r.log_likelihood for r in L.score(docs, model=(m, vocab)).collect()) for m in (net, start))
    assert better > 0.95 * plain > plain
    assert L.score(no_docs).count() == 0


def test_every_window_of_the_corpus_trains(spark, monkeypatch):
    """What the shards train adds up to the words of the distinct texts, and copies weigh as often as they occur."""
    docs = spark.createDataFrame([(i, f"w{i} is word number {i} of a text ") for i in range(50)] + [(90, "one more"), (91, "one more"), (92, None)],
                                 "doc_id long, text string")
    for shards in (1, 3, 9):
        rows, weight = 0, 0
        texts = L.shards_of(docs, "text", shards)
        for r in range(L.ROUNDS):
            part = texts if shards < L.ROUNDS else texts.where(F.col("shard") % L.ROUNDS == r)
            table = L._in_order(part, 2).toArrow()
            found, copies = L._windows(table, L.Vocabulary(np.zeros(0, np.uint64), np.zeros(L.TOKENS)), L.WINDOWS_PER_MILLION)
            rows, weight = rows + len(found), weight + copies.sum()
        times = L.ROUNDS if shards < L.ROUNDS else 1
        assert (rows, weight) == (times * (50 * 8 + 2), times * (50 * 8 + 4))
    # the layout of the rows doesn't matter
    monkeypatch.setattr(L, "SHARD_WINDOWS", 4000)
    many = spark.createDataFrame([(i, " ".join(f"x{(i * 31 + k * 17) % 400}" for k in range(300))) for i in range(50)], "doc_id long, text string")
    models = [L.train(d) for d in (many, many.repartition(7))]
    assert all(np.allclose(models[0][0].w[k], models[1][0].w[k], atol=1e-4) for k in models[0][0].w)
    # a window that occurs twice weighs as two windows
    net, rng = L.Network(), np.random.default_rng(1)
    context, token = rng.integers(0, L.TOKENS, (40, 2 * L.SIDE)), rng.integers(0, L.TOKENS, 40)
    copies = np.ones(40)
    copies[:5] = 2
    once = net.gradients(context, token, copies)
    twice = net.gradients(np.concatenate([context, context[:5]]), np.concatenate([token, token[:5]]))
    assert all(np.allclose(once[k], twice[k], atol=1e-6) for k in once)
