"""LM scoring by masked pseudo-likelihood.

Every word of every text is predicted from ``SIDE`` words on both sides of it, as if it were
masked, and the log-probabilities are summed over the text.

Vocabulary: word counts over the whole corpus (aggregated map side); the ``TOP`` most frequent
words are a token each, all other words share ``REST`` tokens dealt by hash.  Output is a two-level
softmax: ``CLASSES`` classes, then the tokens of the class.  The network (embeddings of the context
positions, one tanh layer, two softmaxes) is plain numpy.  It is trained on every window of every
text: texts are dealt to shards of about ``SHARD_WINDOWS`` windows by a hash, each shard trains a copy of
the network in one of ``ROUNDS`` rounds (in all of them while there are fewer shards than rounds), and
a round's copies are averaged by a tree of sums, so the driver never holds more than ``FAN_IN`` networks.
Equal texts meet in a shard and are trained as one whose windows count as often as it occurs, so
copies cost no task more.  A shard is trained in an order of its own, so the network doesn't depend on how rows
are laid out.  Scoring is one scan without a shuffle, with the weights and the vocabulary broadcast (their sizes
are fixed by parameters).

Defined cases: null, empty and blank texts have no word, log-likelihood 0 and a null mean; context
beyond the ends of a text is a border token; a word that was never counted falls to its hash token;
an empty corpus gives uniform probabilities.  Repeated rows score alike; extra columns pass through;
clashing ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castplan.llm import textwords as tw
from castplan.llm.shared import materialize, text_chunks, without

SIDE, WIDTH, HIDDEN = 2, 12, 24
TOP, REST, CLASSES = 960, 64, 32
TOKENS = TOP + REST
IN_CLASS = TOKENS // CLASSES
BORDER = TOKENS
#: ``WINDOWS_PER_MILLION``: of a million words, those that train; all of them.
WINDOWS_PER_MILLION, SHARD_WINDOWS, ROUNDS, FAN_IN = 1_000_000, 500_000, 4, 32
BATCH, LEAST_STEPS, SEED = 4096, 100, 11


class Vocabulary:
    """Frequent word hashes and their tokens; the count of every token."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.tokens, self.counts = hashes[order], order, counts

    def tokens_of(self, words: np.ndarray) -> np.ndarray:
        out = TOP + (words % np.uint64(REST)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            known = self.hashes[at] == words
            out[known] = self.tokens[at[known]]
        return out


def _counter(batches):
    """Partial word counts of a batch: (hash, count) rows."""
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column(0), 1 << 20):
            hashes = tw.word_hashes(data, offsets, tw.SPACE_WORDS)[0]
            words, counts = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "n"])


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)``: how often each hashed word occurs in the corpus."""
    return docs.select(text_col).mapInArrow(_counter, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The vocabulary of a corpus; ``TOP + REST`` rows reach the driver."""
    top = counts.orderBy(F.desc("n"), "word").limit(TOP).collect()
    sums = counts.groupBy(F.pmod("word", F.lit(REST)).alias("t")).agg(F.sum("n").alias("n")).collect()
    weights = np.zeros(TOKENS)
    for r in sums:
        weights[TOP + r.t] = r.n
    for k, r in enumerate(top):
        weights[k] = r.n
        weights[TOP + r.word % REST] -= r.n
    return Vocabulary(np.array([r.word for r in top], np.int64).view(np.uint64), weights)


def windows_of(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ``2 * SIDE`` context tokens of every word; ``BORDER`` beyond a text's ends."""
    n = len(tokens)
    out = np.full((n, 2 * SIDE), BORDER, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lo, hi = first[doc], first[doc + 1]
    at = np.arange(n)
    for k, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        j = at + shift
        ok = (j >= lo) & (j < hi)
        out[ok, k] = tokens[j[ok]]
    return out


class Network:
    """Context embeddings -> tanh layer -> class softmax and token-in-class softmax."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.w = {"e": rng.normal(0, 0.1, (TOKENS + 1, WIDTH)).astype(f), "h": rng.normal(0, 0.15, (2 * SIDE * WIDTH, HIDDEN)).astype(f),
                  "hb": np.zeros(HIDDEN, f), "c": np.zeros((HIDDEN, CLASSES), f), "cb": np.zeros(CLASSES, f),
                  "t": np.zeros((CLASSES, HIDDEN, IN_CLASS), f), "tb": np.zeros((CLASSES, IN_CLASS), f)}

    def hidden(self, context: np.ndarray) -> np.ndarray:
        return np.tanh(self.w["e"][context].reshape(len(context), -1) @ self.w["h"] + self.w["hb"])

    def log_probabilities(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """log p(token | both sides), for every row."""
        h = self.hidden(context)
        cls, inner = token % CLASSES, token // CLASSES
        z = h @ self.w["c"] + self.w["cb"]
        z -= z.max(axis=1, keepdims=True)
        out = z[np.arange(len(z)), cls] - np.log(np.exp(z).sum(axis=1))
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            rows = order[cuts[k]:cuts[k + 1]]
            if len(rows):
                z = h[rows] @ self.w["t"][k] + self.w["tb"][k]
                z -= z.max(axis=1, keepdims=True)
                out[rows] += z[np.arange(len(rows)), inner[rows]] - np.log(np.exp(z).sum(axis=1))
        return out

    def gradients(self, context: np.ndarray, token: np.ndarray, copies: np.ndarray | None = None) -> dict:
        """Gradients of the mean loss of the rows, each counted ``copies`` times."""
        n = len(token)
        order = np.argsort(token % CLASSES, kind="stable")
        context, token = context[order], token[order]
        cls, inner = token % CLASSES, token // CLASSES
        x = self.w["e"][context].reshape(n, -1)
        h = np.tanh(x @ self.w["h"] + self.w["hb"])
        share = np.full((n, 1), 1 / n, h.dtype) if copies is None else (copies[order] / copies.sum()).astype(h.dtype)[:, None]

        def softmax(z):
            z = np.exp(z - z.max(axis=1, keepdims=True))
            return z / z.sum(axis=1, keepdims=True)

        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        d = softmax(h @ self.w["c"] + self.w["cb"])
        d[np.arange(n), cls] -= 1
        d *= share
        g["c"], g["cb"] = h.T @ d, d.sum(axis=0)
        dh = d @ self.w["c"].T
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        parts = [(k, slice(cuts[k], cuts[k + 1])) for k in np.flatnonzero(np.diff(cuts))]
        z = self.w["tb"][cls]
        for k, rows in parts:
            z[rows] += h[rows] @ self.w["t"][k]
        d = softmax(z)
        d[np.arange(n), inner] -= 1
        d *= share
        for k, rows in parts:
            g["t"][k], g["tb"][k] = h[rows].T @ d[rows], d[rows].sum(axis=0)
            dh[rows] += d[rows] @ self.w["t"][k].T
        dz = dh * (1 - h * h)
        g["h"], g["hb"] = x.T @ dz, dz.sum(axis=0)
        places = context.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
        g["e"] = np.bincount(places.ravel(), (dz @ self.w["h"].T).ravel(), g["e"].size).reshape(g["e"].shape).astype(g["e"].dtype)
        return g


def unigram_start(network: Network, counts: np.ndarray) -> None:
    """Output biases that give the corpus frequencies before any training."""
    p = np.maximum(counts, 0.5) / np.maximum(counts, 0.5).sum()
    per_class = np.array([p[k::CLASSES] for k in range(CLASSES)])
    network.w["cb"][:] = np.log(per_class.sum(axis=1))
    network.w["tb"][:] = np.log(per_class / per_class.sum(axis=1, keepdims=True))


def train_copy(weights: dict, rows: np.ndarray, copies: np.ndarray, rate: float) -> dict:
    """Adam over ``(token, context...)`` rows, each of so many ``copies``, from the given weights: one pass, or as
    many as make ``LEAST_STEPS`` steps."""
    net = Network.__new__(Network)
    net.w = {k: v.copy() for k, v in weights.items()}
    m = {k: np.zeros_like(v) for k, v in weights.items()}
    v2 = {k: np.zeros_like(v) for k, v in weights.items()}
    batches = [slice(lo, lo + BATCH) for lo in range(0, len(rows), BATCH)]
    for step, part in enumerate(batches * -(-LEAST_STEPS // len(batches)), 1):
        for k, d in net.gradients(rows[part, 1:].astype(np.int64), rows[part, 0].astype(np.int64), copies[part]).items():
            m[k] += 0.1 * (d - m[k])
            v2[k] += 0.001 * (d * d - v2[k])
            net.w[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net.w


def _flat(weights: dict) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)]).astype(np.float64)


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


_COPY = "shard long, n long, weights binary"


def _copy_table(shard: int, n: int, total: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([n], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})


def _windows(table: pa.Table, vocab: Vocabulary, per_million: int) -> tuple[np.ndarray, np.ndarray]:
    """``(token, context...)`` of every word of the texts, and how often its text occurs."""
    rows, copies = [np.zeros((0, 1 + 2 * SIDE), np.int16)], [np.zeros(0, np.float32)]
    times = table.column("copies").to_numpy().astype(np.float32)
    for lo, hi, data, offsets in text_chunks(table.column("text")):
        hashes, _, _, first = tw.word_hashes(data, offsets, tw.SPACE_WORDS)
        tokens = vocab.tokens_of(hashes)
        found = np.column_stack([tokens, windows_of(tokens, first)]).astype(np.int16)
        often = np.repeat(times[lo:hi], np.diff(first))
        if per_million < 1_000_000:
            some = np.random.default_rng(SEED).random(len(found)) * 1e6 < per_million
            found, often = found[some], often[some]
        rows.append(found)
        copies.append(often)
    return np.concatenate(rows), np.concatenate(copies)


def _fit_shard(shipped, weights, rate: float, per_million: int):
    def fit(key, table):
        rows, copies = _windows(table, shipped.value, per_million)
        if len(rows) == 0:
            return _copy_table(key[0].as_py(), 0, 0 * _flat(weights.value))
        mixed = np.random.default_rng(SEED).permutation(len(rows))
        return _copy_table(key[0].as_py(), len(rows), len(rows) * _flat(train_copy(weights.value, rows[mixed], copies[mixed], rate)))
    return fit


def shards_of(docs: DataFrame, text_col: str, shards: int) -> DataFrame:
    """``(shard, key, text)`` of every text; equal texts are in one shard."""
    key = F.xxhash64(text_col)
    return docs.where(F.col(text_col).isNotNull()).select(F.pmod(key, F.lit(shards)).alias("shard"), key.alias("key"), F.col(text_col).alias("text"))


def _in_order(texts: DataFrame, shards: int) -> DataFrame:
    """The distinct texts of the shards and their ``copies``, sorted in each shard."""
    counted = texts.repartition(shards, "shard").groupBy("shard", "key", "text").agg(F.count(F.lit(1)).alias("copies"))
    return counted.sortWithinPartitions("shard", "key", "text")


def _add_copies(key, table):
    parts = sorted(zip(table.column("shard").to_pylist(), table.column("n").to_pylist(), table.column("weights").to_pylist(), strict=True))
    return _copy_table(key[0].as_py(), sum(x[1] for x in parts), np.sum([np.frombuffer(x[2]) for x in parts], axis=0))


def train(docs: DataFrame, text_col: str = "text") -> tuple[Network, Vocabulary]:
    """Vocabulary and network of a corpus."""
    spark = docs.sparkSession
    vocab = vocabulary(materialize(count_words(docs, text_col), "word-counts"))
    network = Network()
    unigram_start(network, vocab.counts)
    shipped = spark.sparkContext.broadcast(vocab)
    n = int(vocab.counts.sum()) * WINDOWS_PER_MILLION // 1_000_000
    if n == 0:
        return network, vocab
    shards = -(-n // SHARD_WINDOWS)
    texts = shards_of(docs, text_col, shards)
    like = {k: v.copy() for k, v in network.w.items()}
    for r in range(ROUNDS):
        now = spark.sparkContext.broadcast(network.w)
        part = texts if shards < ROUNDS else texts.where(F.col("shard") % ROUNDS == r)
        fit = _fit_shard(shipped, now, 0.01 / (1 + r), WINDOWS_PER_MILLION)
        copies = materialize(_in_order(part, -(-shards // ROUNDS)).groupBy("shard").applyInArrow(fit, _COPY), "copies")
        left = shards
        while left > FAN_IN:
            left = -(-left // FAN_IN)
            copies = copies.select(F.floor(F.col("shard") / FAN_IN).alias("up"), "shard", "n", "weights").groupBy("up").applyInArrow(_add_copies, _COPY)
        parts = sorted((x.shard, x.n, bytes(x.weights)) for x in copies.collect())
        if trained := sum(x[1] for x in parts):
            network.w = _shaped(np.sum([np.frombuffer(x[2]) for x in parts], axis=0) / trained, like)
    return network, vocab


ADDED = ["n_words", "log_likelihood", "mean_log_likelihood"]


def score(docs: DataFrame, text_col: str = "text", keep: list | None = None, model: tuple | None = None) -> DataFrame:
    """``keep`` columns (all by default) plus the summed and the mean log-probability of the words."""
    base = without(docs, *[c for c in ADDED if c != text_col])
    keep = base.columns if keep is None else keep
    network, vocab = train(docs, text_col) if model is None else model
    shipped = docs.sparkSession.sparkContext.broadcast((network.w, vocab))

    def run(batches):
        weights, words = shipped.value
        net = Network.__new__(Network)
        net.w = weights
        for batch in batches:
            counts, sums = [], []
            for _, _, data, offsets in text_chunks(batch.column(len(keep)), 1 << 18):
                hashes, _, _, first = tw.word_hashes(data, offsets, tw.SPACE_WORDS)
                tokens = words.tokens_of(hashes)
                own = np.zeros(len(tokens))
                context = windows_of(tokens, first)
                for lo in range(0, len(tokens), 16384):
                    own[lo:lo + 16384] = net.log_probabilities(context[lo:lo + 16384], tokens[lo:lo + 16384])
                total = np.concatenate([[0], np.cumsum(own)])
                counts.append(np.diff(first))
                sums.append(total[first[1:]] - total[first[:-1]])
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            s = np.concatenate(sums) if sums else np.zeros(0)
            mean = np.where(n > 0, s / np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(n), pa.array(s), pa.array(mean, mask=n == 0)],
                                             names=[*keep, *ADDED])

    fields = [base.schema[c] for c in keep]
    added = [T.StructField("n_words", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("mean_log_likelihood", T.DoubleType())]
    return base.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, T.StructType([*fields, *added]))
