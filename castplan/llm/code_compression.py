"""Vector code compression: product codes whose codebooks are trained with norm-of-sum bounds.

Every component becomes the integer floor(4096 x); a vector is cut into equal consecutive parts, and
each part position has a codebook of 16 entries, which starts as that part of the vectors of the 16
least ids.  A round assigns every part to its nearest entry and replaces the entries by the floors of
their parts' means; the rounds are exact Lloyd rounds, and bounds only save work.

For every part of every vector the table of a round keeps the assigned entry, an upper bound (the
distance to that entry when it was last measured), a lower bound (the distance to the nearest other
entry when all were last measured), and the stamp of the round in which each bound was measured.  All
codebooks of earlier rounds are kept.  So a bound of round s is carried to round t by the true net
displacement |C_t[j] - C_s[j]|, the norm of the sum of an entry's moves, and not by the sum of their
norms, which is never smaller: upper + |net move of the entry| must stay below lower - the largest net
move of another entry.  Where it doesn't, the distance to the assigned entry is measured again, and
only if that fails too, all entries are rescanned in exact integer arithmetic (ties to the lower index).

Every round reads the last round's table, writes its own under ``spark.checkpoint.dir`` (one scan
gives the new states and the tasks' changes to the sums) and deletes the one before: a lost executor
costs the tasks it ran.  Only codebooks and their sums, bounded by their size, reach the driver.

Defined cases: rows whose vector is null, empty or holds null or non-finite components go, and so do
vectors of another length than the most frequent one; a length that the parts don't divide gives the
first parts one component more; an id of several rows starts one entry, from its least vector; a null
id counts as the last; with fewer ids than entries the codebooks are smaller; entries that nothing
is assigned to stay; integers are clipped to 2^61 in magnitude; errors beyond a long are null.  Extra columns pass through; columns that clash
with the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castplan.llm import vectors as V
from castplan.llm.shared import discard, materialize, without, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: More than the rounding of the stored single-precision bounds and of square roots, as a share.
SLACK = 1e-6
ADDED = ["code", "error"]


def cuts(dim: int, parts: int) -> list:
    return [slice(c[0], c[-1] + 1) if len(c) else slice(0, 0) for c in np.array_split(np.arange(dim), parts)]


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows: longs where all of them fit, else Python integers."""
    far = sum(int(np.abs(v).max(initial=0)) for v in (x, entry))
    kind = np.int64 if far * far * max(x.shape[1], 1) < 1 << 62 else object
    d = x.astype(kind) - entry.astype(kind)
    return (d * d).sum(1) if d.shape[1] else np.zeros(len(x), kind)


def root(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(float))


def scan(x: np.ndarray, book: np.ndarray):
    """``(nearest entry, its distance, distance to the nearest other)``, the last two squared and exact."""
    best, least = np.zeros(len(x), np.int64), squared(x, book[:1])
    other = np.full(len(x), math.inf, object)
    for e in range(1, len(book)):
        near = squared(x, book[e:e + 1])
        closer = (near < least).astype(bool)
        other = np.minimum(other, np.where(closer, least, near))
        best, least = np.where(closer, e, best), np.where(closer, near, least)
    return best, least, other


def moves(history: list, part: int, now: int) -> np.ndarray:
    """``[s, j]``: the net displacement |C_now[j] - C_s[j]| of every entry since round s."""
    return np.array([[math.sqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(new, old, strict=True)))
                      for new, old in zip(history[now][part], history[s][part], strict=True)] for s in range(now)])


def others_most(moved: np.ndarray) -> np.ndarray:
    """``[s, j]``: the largest displacement of an entry other than j."""
    out = np.zeros_like(moved)
    for j in range(moved.shape[1]):
        out[:, j] = np.delete(moved, j, 1).max(1, initial=0.0)
    return out


#: The state of one part: entry, upper bound and its stamp, lower bound and its stamp.
STATE = np.dtype([("entry", "u1"), ("upper_at", "u1"), ("lower_at", "u1"), ("upper", "<f4"), ("lower", "<f4")])


def reassign(x: np.ndarray, state: np.ndarray | None, history: list, part: int, drift=None) -> tuple[np.ndarray, int]:
    """The state of one part of all rows against the newest codebook, and how many were rescanned."""
    now = len(history) - 1
    book = history[now][part]
    out = np.zeros(len(x), STATE) if state is None else state.copy()
    if state is None:
        todo = np.arange(len(x))
    else:
        moved, most = drift
        a = state["entry"]
        upper = (state["upper"].astype(float) + moved[state["upper_at"], a]) * (1 + SLACK)
        lower = state["lower"].astype(float) * (1 - SLACK) - most[state["lower_at"], a] * (1 + SLACK)
        todo = np.flatnonzero(~(upper < lower))
        if len(todo):  # measure the assigned entry again
            near = root(squared(x[todo], book[a[todo]]))
            out["upper"][todo], out["upper_at"][todo] = near, now
            todo = todo[~(near * (1 + SLACK) < lower[todo])]
    if len(todo):
        best, least, other = scan(x[todo], book)
        out["entry"][todo] = best
        out["upper"][todo], out["lower"][todo] = root(least), root(other)
        out["upper_at"][todo] = out["lower_at"][todo] = now
    return out, len(todo)


def _rows(batch, dim: int):
    return V.floor_scaled(V.matrix(batch.column("_x"), dim), SCALE)


def _round(dim: int, parts: int, entries: int, history: list, names: list, first: bool):
    """One scan: rows with their new state, and per task one row for each (part, entry) whose parts changed:
    the change of its count and sums."""
    cut = cuts(dim, parts)

    def run(batches):
        change = {}
        drift = None
        for batch in batches:
            if drift is None and not first:
                drift = [(m, others_most(m)) for m in (moves(history, p, len(history) - 1) for p in range(parts))]
            x = _rows(batch, dim)
            old = None if first else np.frombuffer(b"".join(batch.column("_state").to_pylist()), STATE).reshape(-1, parts)
            new = np.zeros((len(x), parts), STATE)
            for p in range(parts):
                own = x[:, cut[p]]
                new[:, p], _ = reassign(own, None if first else old[:, p], history, p, None if first else drift[p])
                for sign, entry in ((1, new["entry"][:, p]),) if first else ((1, new["entry"][:, p]), (-1, old["entry"][:, p])):
                    at = np.arange(len(x)) if first else np.flatnonzero(new["entry"][:, p] != old["entry"][:, p])
                    for e in np.unique(entry[at]):
                        there = own[at[entry[at] == e]]
                        delta = [sign * len(there), *(sign * s for s in V.total(there))]
                        was = change.get((p, int(e)))
                        change[p, int(e)] = delta if was is None else [a + b for a, b in zip(was, delta, strict=True)]
            width = STATE.itemsize * parts
            raw = np.ascontiguousarray(new).tobytes()
            state = pa.array([raw[i:i + width] for i in range(0, len(raw), width)], pa.binary())
            none = pa.nulls(len(x))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], batch.column("_x"), state, none.cast(pa.int64()), none.cast(pa.list_(pa.decimal128(38, 0)))],
                                             names=[*names, "_x", "_state", "_slot", "_change"])
        if change:
            blank = [pa.nulls(len(change), t) for t in types]
            yield pa.RecordBatch.from_arrays([*blank, pa.nulls(len(change), pa.list_(pa.float64())), pa.nulls(len(change), pa.binary()),
                                              pa.array([p * entries + e for p, e in change], pa.int64()), pa.array(list(change.values()), pa.list_(pa.decimal128(38, 0)))],
                                             names=[*names, "_x", "_state", "_slot", "_change"])
    types: list = []
    return run, types


def first_entries(rows: DataFrame, id_col: str, dim: int, entries: int) -> np.ndarray:
    """The integer vectors of the least ids.  Each task names its least ids; only their rows are read."""
    def least(batches):
        ids: list = []
        for batch in batches:
            ids = sorted({*ids, *batch.column(0).to_pylist()})[:entries]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["_id"])

    keyed = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_id"), "_x")
    ids = [r[0] for r in keyed.select("_id").mapInArrow(least, "_id long").distinct().orderBy("_id").limit(entries).collect()]
    found = keyed.where(F.col("_id").isin(ids)).groupBy("_id").agg(F.min("_x").alias("_x")).collect() if ids else []
    x = np.array([r["_x"] for r in sorted(found, key=lambda r: r["_id"])], float).reshape(-1, dim)
    return V.floor_scaled(x, SCALE)


class Codebooks:
    """The trained codebooks (one integer matrix per part) and their history."""

    def __init__(self, history: list, dim: int):
        self.history, self.dim = history, dim

    @property
    def books(self) -> list:
        return self.history[-1]

    def digest(self) -> str:
        """SHA-256 of all integer components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(v)) for book in self.books for e in book for v in e).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """``(rows, codebooks)``: the columns of ``df`` but the vector, ``code`` (two hex digits per part) and
    ``error`` (the squared distances to the final entries, summed over the parts)."""
    spark = df.sparkSession
    base = without(df, *ADDED, "_x", "_state", "_slot", "_change")
    names = [c for c in base.columns if c != vec_col]
    rows, dim, n = V.fit_rows(base, vec_col)
    rows = rows.select(*names, "_x")
    fields = [T.StructField(c, base.schema[c].dataType) for c in names]
    result = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not n:
        return spark.createDataFrame([], result), Codebooks([[]], 0)
    start = first_entries(rows, id_col, dim, entries)
    cut = cuts(dim, parts)
    history = [[start[:, c] for c in cut]]
    size = len(start)
    schema = T.StructType([*fields, rows.schema["_x"], T.StructField("_state", T.BinaryType()), T.StructField("_slot", T.LongType()), T.StructField("_change", V.EXACT)])
    blank = _arrow_types(fields)
    totals: dict = {}
    table = path = None
    for k in range(rounds + 1):
        step, types = _round(dim, parts, entries, list(history), names, k == 0)
        types.extend(blank)
        source = rows if table is None else table.where("_slot IS NULL").select(*names, "_x", "_state")
        earlier = path
        table, path = written(source.mapInArrow(step, schema), f"codes-{k}")
        if earlier:
            discard(spark, earlier)
        if k == rounds:
            break
        for slot, delta in V.exact_sums(table.where("_slot IS NOT NULL"), "_slot", "_change").items():
            totals[slot] = [a + b for a, b in zip(totals[slot], delta, strict=True)] if slot in totals else delta
        history.append([np.array([_mean(totals.get(p * entries + e), history[-1][p][e]) for e in range(size)], np.int64).reshape(size, -1)
                        for p in range(parts)])
    books = Codebooks(history, dim)
    last = history[-1]

    def code(batches):
        for batch in batches:
            x = _rows(batch, dim)
            entry = np.frombuffer(b"".join(batch.column("_state").to_pylist()), STATE).reshape(-1, parts)["entry"]
            error = sum((squared(x[:, cut[p]], last[p][entry[:, p]]).astype(object) for p in range(parts)), np.zeros(len(x), object))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([bytes(e).hex() for e in entry], pa.string()), V.as_long(error)],
                                             names=[*names, *ADDED])

    return table.where("_slot IS NULL").select(*names, "_x", "_state").mapInArrow(code, result), books


def _mean(total, entry):
    """The floors of a slot's mean; an entry without parts stays."""
    return [s // total[0] for s in total[1:]] if total and total[0] else [int(v) for v in entry]


def _arrow_types(fields: list) -> list:
    from pyspark.sql.pandas.types import to_arrow_type
    return [to_arrow_type(f.dataType) for f in fields]


def add_group_totals(rows: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of equal ``group`` (nulls together).

    Sums are pre-aggregated.  A group of more than a thousandth of all rows gets its sum by a broadcast
    of at most a thousand rows; the others, none of which is hot, by a shuffle join.
    """
    totals = materialize(rows.groupBy(F.col(group).alias("_group")).agg(F.sum(F.col(value).cast("decimal(38,0)")).alias("_sum"), F.count(F.lit(1)).alias("_n")), "totals")
    n = totals.agg(F.sum("_n")).first()[0] or 0
    hot = totals.where(F.col("_n") * 1000 > n).select("_group", F.col("_sum").alias("_hot"), F.lit(True).alias("_is"))
    marked = rows.join(F.broadcast(hot), F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    done = marked.where("_is").withColumn(out, F.expr("try_cast(_hot AS long)")).drop("_hot", "_is")
    cold = totals.where(F.col("_n") * 1000 <= n).select("_group", "_sum")
    rest = marked.where("_is IS NULL").drop("_hot", "_is").join(cold, F.col(group).eqNullSafe(F.col("_group")), "left")
    return done.unionByName(rest.withColumn(out, F.expr("try_cast(_sum AS long)")).drop("_group", "_sum"))
