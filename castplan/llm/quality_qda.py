"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One scan turns every whole text into ``STATISTICS`` (byte-class shares, word shape, repetition;
log and square-root transforms), by numpy over the text bytes.  Class counts, sums and cross
products of the labelled training rows are added up by Spark (no sample); means and covariances
come from those.  Covariances are shrunk towards the pooled one and towards its diagonal, and
their Cholesky factors are computed once and shipped with the scoring scan.  A document's raw
score is the difference of the two Mahalanobis log densities; a logistic map, set on the training
rows, sends it to 0..1 with ``CUT`` at the best balanced accuracy.

Defined cases: null and empty texts get the statistics of an empty text and are scored like any
other; null labels, null ids and labels other than 0 and 1 are not learned from; repeated labels
count as often as they occur; with a missing class every score is the share of label 1 (0.5 with no
label at all).  Extra columns pass through; columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castplan.llm import textwords as tw
from castplan.llm.shared import materialize, text_chunks, without

CUT = 0.3
TO_POOLED, TO_DIAGONAL = 0.2, 0.05
STATISTICS = ["log_bytes", "upper", "digit", "punct", "marks", "bars", "shout", "space", "lines", "wide",
              "word_len", "word_len_sd", "log_words", "distinct", "same_as_before", "upper_words", "marked_words"]
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:'\"()-?"]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#%&$*@^~_=+<>{}[]\\/`"]] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    least = np.maximum(size, 1)
    starts, ends, first = tw.words(data, offsets, tw.SPACE_WORDS)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)

    def count(flags):  # per text
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])

    def per_word(values):
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=float)])[first])

    upper, marks, bang = _UPPER[data], _MARKS[data], data == ord("!")
    length = (ends - starts).astype(float)
    mean = per_word(length) / some
    hashes = tw.span_hash(tw.prefix_hash(tw.SPACE_WORDS[1][data]), starts, ends)
    doc = np.repeat(np.arange(n), np.diff(first))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    # distinct words: the text's number in the upper bits, the hash in the lower
    bits = np.uint64(max(1, int(n).bit_length()))
    tagged = np.sort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits))
    fresh = np.concatenate([[True], tagged[1:] != tagged[:-1]]) if len(tagged) else np.zeros(0, bool)
    distinct = np.bincount((tagged[fresh] >> (np.uint64(64) - bits)).astype(np.int64), minlength=n)
    caps = np.concatenate([[0], np.cumsum(upper, dtype=np.int64)])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    odd = np.concatenate([[0], np.cumsum(marks | bang | (data == ord("|")), dtype=np.int64)])
    in_caps, in_word = caps[ends] - caps[starts], letters[ends] - letters[starts]
    root = np.sqrt
    return np.column_stack([
        np.log1p(size), root(count(upper) / least), root(count(_DIGIT[data]) / least), root(count(_PUNCT[data]) / least),
        root(count(marks) / least), root(count(data == ord("|")) / least), root(count(bang) / least),
        root(count((data == 32) | (data == 9)) / least), root(count(data == 10) / least), root(count(data >= 128) / least),
        np.log1p(mean), np.log1p(root(np.maximum(per_word(length * length) / some - mean * mean, 0))), np.log1p(words),
        root(distinct / some), root(per_word(again) / some), root(per_word((in_caps > 1) & (2 * in_caps > in_word)) / some),
        root(per_word(odd[ends] > odd[starts]) / some)])


def _measure(text_col: str, keep: list):
    def run(batches):
        for batch in batches:
            rows = [statistics(d, o).astype(np.float32) for _, _, d, o in text_chunks(batch.column(text_col))]
            flat = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)), np.float32)
            offs = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.ListArray.from_arrays(offs, pa.array(flat.ravel()))],
                                             names=[*keep, "_stats"])
    return run


def measure(docs: DataFrame, text_col: str = "text", keep: list | None = None) -> DataFrame:
    """``keep`` columns (all by default) and the statistics of every text as ``_stats``."""
    keep = docs.columns if keep is None else keep
    fields = [docs.schema[c] for c in keep]
    own = docs.select(*keep) if text_col in keep else docs.select(*keep, text_col)
    return own.mapInArrow(_measure(text_col, keep), T.StructType([*fields, T.StructField("_stats", T.ArrayType(T.FloatType()))]))


class Model:
    """Class means, cached Cholesky factors and the map from log-density difference to score."""

    def __init__(self, prior: float, means=None, factors=None):
        self.prior, self.means, self.factors = prior, means, factors
        self.shift, self.scale = 0.0, 1.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log N(x; class 1) - log N(x; class 0), by forward substitution with the factors."""
        logs = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        at = (self.difference(x.astype(float)) - self.shift) / self.scale + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


def _moments(batches):
    k = len(STATISTICS)
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(float)
        for c in (0, 1):
            own = x[label == c]
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])])], names=["label", "sums"])


def fit(labelled: DataFrame) -> Model:
    """Fit on ``(label 0/1, _stats)`` rows, all of them; only sums of moments reach the driver."""
    k = len(STATISTICS)
    parts = labelled.select(F.col("label").cast("int").alias("label"), "_stats").mapInArrow(_moments, "label int, sums array<double>")
    sums = parts.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("s")).collect()
    raw = {c: np.zeros(1 + k + k * k) for c in (0, 1)}
    for r in sums:
        raw[r.label][r.pos] = r.s
    n = {c: raw[c][0] for c in raw}
    if min(n.values()) < 2:
        total = sum(n.values())
        return Model(n[1] / total if total else 0.5)
    means = [raw[c][1:1 + k] / n[c] for c in (0, 1)]
    covs = [raw[c][1 + k:].reshape(k, k) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
    factors = []
    for cov in covs:
        mixed = (1 - TO_POOLED) * cov + TO_POOLED * pooled
        mixed = (1 - TO_DIAGONAL) * mixed + TO_DIAGONAL * np.diag(np.diag(mixed))
        factors.append(np.linalg.cholesky(mixed + 1e-5 * np.eye(k)))
    model = Model(n[1] / (n[0] + n[1]), means, factors)
    _calibrate(model, labelled, n)
    return model


def _calibrate(model: Model, labelled: DataFrame, n: dict) -> None:
    """Set the cut at the best balanced accuracy of the training rows, from a histogram of their
    differences in 400 bins on an asinh scale; the scale is that histogram's spread."""
    edges = np.sinh(np.linspace(-9, 9, 401))

    def bins(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            at = np.clip(np.searchsorted(edges, model.difference(x.astype(float))), 0, 400)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32))], names=["label", "bin"])

    got = (labelled.select(F.col("label").cast("int").alias("label"), "_stats").mapInArrow(bins, "label int, bin int")
           .groupBy("label", "bin").count().collect())
    share = np.zeros((2, 402))
    for r in got:
        if r.label in (0, 1):
            share[r.label, r.bin + 1] = r["count"] / n[r.label]
    below = share.cumsum(axis=1)
    balance = below[0] + 1 - below[1]  # predicted 1 above the edge
    best = np.flatnonzero(balance >= balance.max() - 1e-12)
    at = int(np.clip(best[len(best) // 2], 1, 401)) - 1  # the middle of the best plateau
    model.shift = float(edges[min(at, 400)])
    middle = np.sinh((np.arange(401) - 200) * 18 / 400)
    weight = share[:, 1:].mean(axis=0)
    model.scale = float(max(1.0, np.sqrt((weight * np.minimum(np.abs(middle - model.shift), 50) ** 2).sum())))


def training_row(id_col: str = "doc_id") -> Column:
    """Rows to learn from: crc32 of the id as text isn't divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id",
          learn_from: Column | None = None, keep: list | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) plus ``score`` and ``predicted``.

    Labels are joined by id only to learn the model; a score depends on the text alone.
    """
    base = without(docs, "score", "predicted")
    keep = base.columns if keep is None else keep
    narrow = materialize(measure(base.select(F.col(id_col).alias("_id"), text_col), text_col, ["_id"]), "statistics")
    known = (labels.where(learn_from if learn_from is not None else training_row(id_col))
             .where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("_id"), F.col(label_col).alias("label")))
    model = fit(materialize(narrow.join(known, "_id").select("label", "_stats"), "training"))
    # the statistics just written serve a result without texts; others are measured and scored in one scan
    written = keep == [id_col]
    source = narrow.withColumnRenamed("_id", id_col) if written else base.select(*keep, F.col(text_col).alias("_stats"))
    fields = [source.schema[c] for c in keep]

    def run(batches):
        for batch in batches:
            last = batch.column(len(keep))
            if written:
                s = model.score(last.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)))
            else:
                s = np.concatenate([model.score(statistics(d, o).astype(np.float32)) for _, _, d, o in text_chunks(last)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                                             names=[*keep, "score", "predicted"])

    return source.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` predicted 1, in the columns of ``docs``."""
    names = docs.columns
    return score(docs, labels, **options).where("predicted = 1").select(names)
