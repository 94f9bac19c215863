"""K-d tree sharding by distributed weighted medians.

A table of one narrow row per document (size and one ordinal per metadata dimension) is written
once.  Level by level, every node that still has more than one shard is split along the dimension
in which it is widest, at the point that divides its bytes in proportion to the shards of its two
sides (the weighted median for an even split).  The split point of all nodes of a level is found
together by repeated histograms: bytes are added up per node and bin (map side first), the bin
that holds the point becomes the next range, until the bin is one row or is too light to matter.
The driver sees one row per node and pass; a row's position breaks ties of its dimension by a hash
of id and text, so a value that holds a third of all rows is divided like any other.

DataFrame functions only.  Defined cases: a null text has size 1 (no bytes, plus 1), null metadata
sorts first; rows equal in id and text stay together in one shard; an empty table gives an empty
result.  Extra columns don't matter: only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castplan.llm.shared import gapless, materialize

BINS = 4096
#: A cut may be off by a bin of this share of its node's bytes.
TOLERANCE = 1e-4
_HALF = 1 << 31


def text_ordinal(value: Column) -> Column:
    """A text dimension's place on the axis: equal values are one point, nulls come first."""
    return F.coalesce(F.shiftrightunsigned(F.xxhash64(value), 33), F.lit(0)).cast("long")


def linear_ordinal(value: Column, least, most) -> Column:
    """A number's place on the axis between the least and the most value."""
    width = max(1, (most or 0) - (least or 0))
    return F.coalesce(((value - F.lit(least or 0)) / width * (_HALF - 1)).cast("long"), F.lit(0))


def log_ordinal(value: Column) -> Column:
    """A positive number's place on the axis, on a log scale up to 2^62."""
    return F.coalesce((F.log2(F.greatest(value, F.lit(1)).cast("double")) / 62 * (_HALF - 1)).cast("long"), F.lit(0))


def _positions(narrow: DataFrame, dims: int) -> DataFrame:
    place = F.element_at(F.array(*[F.col(f"d{i}") for i in range(dims)]), F.col("dim").cast("int") + 1)
    return narrow.withColumn("pos", place * _HALF + F.col("tie"))


def _table(spark, rows: list, columns: str) -> DataFrame:
    """A literal table of longs, at most one row per shard: small enough to broadcast."""
    values = ", ".join("(" + ", ".join(f"{int(v)}L" for v in row) + ")" for row in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})"))


def _cuts(nodes: DataFrame, spark, todo: dict, dims: int) -> dict:
    """``{node: position}``: rows at or below it go left."""
    done: dict = {}
    state = {n: {"dim": t["dim"], "lo": t["lo"] * _HALF, "hi": t["hi"] * _HALF + _HALF - 1, "before": 0} for n, t in todo.items()}
    while state:
        ranges = _table(spark, [(n, s["dim"], s["lo"], s["hi"], (s["hi"] - s["lo"]) // BINS + 1) for n, s in state.items()],
                        "node, dim, lo, hi, width")
        inside = _positions(nodes.join(ranges, "node"), dims).where("pos BETWEEN lo AND hi")
        bins = inside.groupBy("node", F.expr("(pos - lo) div width").alias("bin")).agg(
            F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
        goals = _table(spark, [(n, int(todo[n]["goal"] - s["before"])) for n, s in state.items()], "node, goal")
        # at most BINS rows per node
        running = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        chosen = (bins.withColumn("upto", running).join(goals, "node").where("upto >= goal")
                  .groupBy("node").agg(F.min_by(F.struct("w", "n", "first", "last", "upto", "goal"), "bin").alias("b")).collect())
        for r in chosen:
            s, b = state[r.node], r.b
            if b.n == 1 or b.first == b.last or b.w <= TOLERANCE * todo[r.node]["bytes"]:
                # the nearer side of the bin
                done[r.node] = b.last if b.upto - b.goal <= b.goal - (b.upto - b.w) else b.first - 1
                del state[r.node]
            else:
                s.update(lo=b.first, hi=b.last, before=s["before"] + b.upto - b.w)
        for n in [n for n in state if n not in {r.node for r in chosen}]:
            done[n] = state.pop(n)["hi"]
    return done


def kd_shards(docs: DataFrame, dimensions: list[Column], shards: int | None = None, target_bytes: int | None = None,
              text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row.

    ``dimensions``: ordinals of 0 to 2^31 - 1 (``text_ordinal``, ``linear_ordinal``,
    ``log_ordinal``).  The leaves are ``shards``, or as many as ``target_bytes`` asks for.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                         crc.alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(id_col, crc), 33).alias("tie"),
                         *[d.alias(f"d{i}") for i, d in enumerate(dimensions)], F.lit(0).cast("long").alias("node"))
    narrow = materialize(narrow, "narrow")
    total, rows = narrow.agg(F.sum("size"), F.count(F.lit(1))).first()
    if shards is None:
        shards = max(1, -(-int(total or 0) // int(target_bytes)))
    nodes, leaves = narrow, {0: shards}
    dims = len(dimensions)
    whole: dict = {}
    while rows and any(k > 1 for k in leaves.values()):
        extents = nodes.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(f"d{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        todo = {}
        for r in extents:
            k = leaves[r.node]
            width = [r[f"hi{i}"] - r[f"lo{i}"] for i in range(dims)]
            whole = whole or {i: max(1, w) for i, w in enumerate(width)}
            if k > 1:
                dim = max(range(dims), key=lambda i: (width[i] / whole[i], -i))  # widest, as a share of the root's
                todo[r.node] = {"dim": dim, "lo": r[f"lo{dim}"], "hi": r[f"hi{dim}"], "bytes": r.bytes, "goal": r.bytes * (k // 2) / k}
        if not todo:  # the shards left over have no rows to divide
            break
        cuts = _cuts(nodes, spark, todo, dims)
        split = _table(spark, [(n, todo[n]["dim"], int(c), leaves[n] // 2) for n, c in cuts.items()], "node, dim, cut, left")
        placed = _positions(nodes.join(split, "node", "left"), dims)
        nodes = placed.withColumn("node", F.when(F.col("pos") > F.col("cut"), F.col("node") + F.col("left")).otherwise(F.col("node"))).drop("dim", "cut", "left", "pos")
        for n in todo:
            leaves[n + leaves[n] // 2] = leaves[n] - leaves[n] // 2
            leaves[n] //= 2
    sharded = nodes.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32")]
    return gapless(sharded, ["shard"], order, "slot", int(rows), F.struct("doc_id", "text_crc32"))
