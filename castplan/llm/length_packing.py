"""Packing into optimal length buckets.

Documents longer than ``max_length`` tokens are cut into pieces of that length (nothing is
dropped), so every piece has a length of 1 to ``max_length``.  The global histogram of piece
lengths (at most ``max_length`` rows) is added up by Spark; dynamic programming over it chooses
the ``buckets`` upper edges that make the total padding least.  Inside each bucket a batch holds
``token_budget // edge`` pieces padded to the edge: piece numbers are gapless per bucket (counted
in slices, no bucket in one task) and a batch is a run of them.

Tokens are words separated by ASCII white space, or any expression the caller gives.

Defined cases: null, empty and wordless texts have no token; they give one row with no piece,
bucket or batch (all null) and 0 tokens.  Repeated rows are packed once each; equal lengths
always share a bucket.  An empty table packs to an empty table.  Extra columns pass through;
columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castplan.llm.shared import gapless, materialize

ADDED = ["n_tokens", "piece", "piece_tokens", "bucket", "bucket_length", "batch", "batch_slot", "padding"]


def count_words(text_col: str = "text") -> Column:
    """Number of runs of characters other than space and controls 9-13."""
    spaced = F.trim(F.translate(F.coalesce(F.col(text_col), F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(spaced == "", 0).otherwise(F.size(F.split(spaced, " +"))).cast("long")


def choose_edges(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list:
    """Bucket edges (ascending, the last is the longest length) of least total padding.

    ``cost(i, j)`` pads all pieces of the i-th to j-th distinct length to the j-th.  The cost
    is concave-monotone, so each row of the table is solved by divide and conquer.
    """
    n = len(lengths)
    if n == 0:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(lengths * counts)])
    infinite = np.iinfo(np.int64).max // 4

    def costs(lo, hi, j):  # first bucket index lo..hi-1, last index j
        return lengths[j] * (rows[j + 1] - rows[lo:hi]) - (tokens[j + 1] - tokens[lo:hi])

    best = np.concatenate([[0], np.full(n, infinite)])
    choice = []
    for _ in range(min(buckets, n)):
        new = np.full(n + 1, infinite)
        cut = np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            top = min(b, mid - 1)
            total = best[a:top + 1] + costs(a, top + 1, mid - 1)
            at = int(np.argmin(total))
            new[mid], cut[mid] = min(int(total[at]), infinite), a + at
            todo += [(lo, mid - 1, a, a + at), (mid + 1, hi, a + at, b)]
        choice.append(cut)
        best = new
        best[0] = infinite
    edges, j = [], n
    for cut in reversed(choice):
        edges.append(int(lengths[j - 1]))
        j = int(cut[j])
    return edges[::-1]


def pieces(docs: DataFrame, max_length: int) -> DataFrame:
    """One row per piece of rows with ``n_tokens``: ``piece`` (0, 1, ...) and ``piece_tokens``."""
    last = F.ceil(F.col("n_tokens") / max_length) - 1
    out = docs.withColumn("piece", F.explode_outer(F.when(F.col("n_tokens") > 0, F.sequence(F.lit(0).cast("long"), last))))
    return out.withColumn("piece_tokens", F.when(F.col("piece").isNotNull(), F.least(F.lit(max_length).cast("long"), F.col("n_tokens") - F.col("piece") * max_length))
                          .otherwise(F.lit(0).cast("long")))


def pack(docs: DataFrame, buckets: int = 12, max_length: int = 4096, token_budget: int = 32768, text_col: str = "text",
         id_col: str = "doc_id", n_tokens: Column | None = None, keep: list | None = None) -> DataFrame:
    """``keep`` columns (by default all but the text) of every piece, with the columns of ``ADDED``.

    Piece ``i`` is the text's tokens ``i * max_length`` up to ``piece_tokens`` more; texts aren't
    copied to their pieces.
    """
    if token_budget < max_length:
        raise ValueError("token_budget must hold one piece of max_length tokens")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (*ADDED, text_col if keep is None else "")]
    counted = docs.select(*names, (count_words(text_col) if n_tokens is None else n_tokens).cast("long").alias("n_tokens"))
    cut = materialize(pieces(counted, max_length), "pieces")
    histogram = cut.where("piece_tokens > 0").groupBy("piece_tokens").count().orderBy("piece_tokens").collect()
    edges = choose_edges(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), buckets)
    if not edges:
        return cut.select(*names, "n_tokens", F.lit(None).cast("long").alias("piece"), "piece_tokens",
                          *[F.lit(None).cast("int" if c in ("bucket",) else "long").alias(c) for c in ADDED[3:]])
    held = F.array(*[F.lit(e).cast("long") for e in edges])
    bucket = F.aggregate(held, F.lit(0), lambda n, e: n + (F.col("piece_tokens") > e).cast("int"))
    cut = cut.withColumn("bucket", F.when(F.col("piece_tokens") > 0, bucket))
    total = sum(r[1] for r in histogram)
    by = F.struct(F.col(id_col), "piece")
    numbered = gapless(cut, ["bucket"], [F.col(id_col).asc_nulls_last(), F.col("piece")], "_number", total, by)
    edge = F.element_at(held, F.col("bucket") + 1)
    room = F.floor(F.lit(token_budget) / edge)
    some = F.col("bucket").isNotNull()
    return numbered.select(*names, "n_tokens", "piece", "piece_tokens", "bucket", F.when(some, edge).alias("bucket_length"),
                           F.when(some, F.floor(F.col("_number") / room)).alias("batch"),
                           F.when(some, F.col("_number") % room).alias("batch_slot"),
                           F.when(some, edge - F.col("piece_tokens")).alias("padding"))
