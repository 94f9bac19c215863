"""Near-duplicate groups by b-bit MinHash.

1. One scan turns each text into its set of hashed word shingles, 176 minima, 35 band keys of
   five minima each, and a packed signature that keeps only the low four bits of every minimum.
2. Texts with equal sets are one class (grouped by a 128-bit digest of the set, aggregated map
   side, so copies cost one row per task).
3. Classes that share a band key fall into one coarse group (star edges to the least class of
   the bucket, never all pairs; connected components).
4. Coarse groups are compared in blocks of bounded size: a pair is a candidate if it shares a
   band and its packed signatures, compared by bit counts and corrected for chance collisions,
   don't rule the threshold out; candidates are confirmed on the full shingle sets.  Pairs that
   are already connected inside the block are skipped, so a block emits a spanning forest.
5. Connected components of the confirmed links, and the least doc_id of each, go back to rows.

At the defaults (similarity 0.8) a pair at the threshold shares no band with probability
(1 - 0.8^5)^35 < 1e-6, and the signature test (4.5 standard errors) loses fewer still.

Defined cases: null, empty or wordless text has the empty set, links with nothing and is its own
component; fewer than ``shingle`` words make one shingle; repeated rows share a class; rows with
a null doc_id join groups but never name one (alone: component null, kept).  Rows that share a
doc_id are one document.  Columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castplan.llm import textwords as tw
from castplan.llm.components import connected_components
from castplan.llm.shared import join_unique, materialize, text_chunks, without

BANDS, ROWS, MINIMA, BITS = 35, 5, 176, 4
#: Shingle hashes (8 bytes each) and texts of one comparison block.
BLOCK_SHINGLES, BLOCK_TEXTS = 400_000, 4096
_SEEDS = np.random.default_rng(20240607).integers(0, 1 << 32, (2, MINIMA), dtype=np.uint64).astype(np.uint32)
_XOR, _MUL = _SEEDS[0], _SEEDS[1] | np.uint32(1)
_LOW_NIBBLES = np.uint64(0x1111111111111111)
#: Null doc_ids get node numbers in the last 2^44 longs, which real ids are taken not to use.
_NO_ID = (1 << 63) - (1 << 44)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int):
    """Per text the sorted distinct hashes of its word shingles (empty without words)."""
    hashes, _, _, first = tw.word_hashes(data, offsets, tw.SPACE_WORDS)
    grams = tw.ngrams(hashes, shingle)
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= shingle:
            own = np.sort(grams[a:b - shingle + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(tw.ngrams(hashes[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of every hash function over one non-empty set."""
    low = (own >> np.uint64(32)).astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        best = np.minimum(best, ((low[i:i + 2048, None] ^ _XOR) * _MUL).min(axis=0))
    return best


def pack(mins: np.ndarray) -> np.ndarray:
    """Low bits of the minima, sixteen to a 64-bit word."""
    nib = (mins & np.uint32(15)).astype(np.uint64).reshape(-1, MINIMA // 16, 16)
    return (nib << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    """One 64-bit key per band from the whole minima."""
    rows = mins[:, :BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(ROWS):
        key = tw.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return key


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures: equal slots, less the 1/2^b that agree by chance."""
    x = a ^ b
    x = (x | (x >> np.uint64(1)) | (x >> np.uint64(2)) | (x >> np.uint64(3))) & _LOW_NIBBLES
    equal = 1.0 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / MINIMA
    chance = 1.0 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def estimate_floor(threshold: float) -> float:
    """Estimates below this rule the threshold out (4.5 standard errors)."""
    chance = 1.0 / (1 << BITS)
    agree = chance + (1 - chance) * threshold
    return threshold - 4.5 * (agree * (1 - agree) / MINIMA) ** 0.5 / (1 - chance)


_SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
                        T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()),
                        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())])


def _sketcher(shingle: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                digest = np.zeros((len(sets), 2), np.uint64)
                mins = np.zeros((len(sets), MINIMA), np.uint32)
                for i, s in enumerate(sets):
                    if len(s):
                        mixed = tw.mix(s)
                        digest[i] = mixed.sum(), tw.mix(mixed ^ np.uint64(0xA5A5A5A5)).sum()
                        mins[i] = minima(s)
                digest = digest.view(np.int64)
                keys = band_keys(mins).view(np.int64)
                packed = pack(mins)
                full = sizes > 0
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]), pa.int32()),
                                                 pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(sizes), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()),
                     bands, pa.array([packed[i].tobytes() if full[i] else None for i in range(len(sets))], pa.binary())],
                    names=[f.name for f in _SKETCH.fields])
    return run


def _intersections(left: list, right: list, pairs: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the named (left, right) sets."""
    out = np.zeros(len(pairs), np.int64)
    li, lp = np.unique(pairs[:, 0], return_inverse=True)
    ri, rp = np.unique(pairs[:, 1], return_inverse=True)
    values = np.concatenate([left[i] for i in li] + [right[i] for i in ri])
    owner = np.repeat(np.arange(len(li) + len(ri)), [len(left[i]) for i in li] + [len(right[i]) for i in ri])
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    keep = counts[column] > 1
    column, owner = np.unique(column[keep], return_inverse=True)[1], owner[keep]
    width = int(column.max()) + 1 if len(column) else 0
    if width * len(li) * len(ri) > 100_000 * len(pairs):
        for k, (i, j) in enumerate(pairs):  # few pairs: merge the two sorted sets
            both = np.sort(np.concatenate([left[i], right[j]]))
            out[k] = int((both[1:] == both[:-1]).sum())
        return out
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    total = np.zeros((len(li), len(ri)), np.float32)
    for lo in range(0, width, 2048):  # many pairs: products of 0/1 slabs of 2,048 shingles
        a, b = np.searchsorted(column, [lo, lo + 2048])
        slab = np.zeros((len(li) + len(ri), 2048), np.float32)
        slab[owner[a:b], column[a:b] - lo] = 1
        total += slab[:len(li)] @ slab[len(li):].T
    return total[lp, rp].astype(np.int64)


def block_links(left: list, right: list | None, threshold_pct: int) -> list:
    """Links of a spanning forest between two blocks (or inside one, ``right`` None).

    A member is ``(node, set, bands, signature words)``.  Some candidates of one member are held at a
    time; a pair whose ends are connected already is skipped, so a group of many near copies costs about one
    run of candidates a member.
    """
    members = left if right is None else left + right
    n = len(left)
    floor = estimate_floor(threshold_pct / 100)
    bands = np.array([m[2] for m in members])
    packed = np.array([m[3] for m in members])
    sets = [m[1] for m in members]
    sizes = np.array([len(s) for s in sets])
    part_of = np.arange(len(members))  # the connected part of every member
    other = np.arange(len(members)) if right is None else np.arange(n, len(members))
    links = []
    for i in range(n):
        js = other[other > i] if right is None else other
        js = js[part_of[js] != part_of[i]]
        step = 4
        while len(js):  # some at a time, then more: what they connect drops out
            step = min(2 * step, 512)
            now, js = js[:step], js[step:]
            # sizes that can reach the threshold at all, a band in common, an estimate that doesn't rule it out
            now = now[(100 * np.minimum(sizes[now], sizes[i]) >= threshold_pct * np.maximum(sizes[now], sizes[i]))]
            now = now[(bands[now] == bands[i]).any(axis=1)] if len(now) else now
            now = now[estimate(packed[now], packed[i]) >= floor] if len(now) else now
            if not len(now):
                continue
            both = _intersections(sets, sets, np.column_stack([np.full(len(now), i), now]))
            good = now[100 * both >= threshold_pct * (sizes[i] + sizes[now] - both)]
            _, first = np.unique(part_of[good], return_index=True)
            links += [(members[i][0], members[int(j)][0]) for j in good[first]]
            part_of[np.isin(part_of, part_of[good])] = part_of[i]
            js = js[part_of[js] != part_of[i]]
    return links


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _linker(shingle: int, threshold_pct: int):
    """Partitions sorted by (grp, low, high) -> links; holds one pair of blocks at a time."""
    def run(batches):
        key, sides = None, ({}, {})
        links: list = []

        def close():
            a, b = list(sides[0].values()), list(sides[1].values())
            if key is not None:
                same = key[1] == key[2]
                links.extend(block_links(a, None if same else b, threshold_pct))

        for batch in batches:
            cols = {c: batch.column(c) for c in batch.schema.names}
            grp, low, high, blk, node = (cols[c].to_numpy(zero_copy_only=False) for c in ("grp", "low", "high", "blk", "node"))
            for lo, hi, data, offsets in text_chunks(cols["text"]):
                sets = shingle_sets(data, offsets, shingle)
                mins = np.array([minima(s) for s in sets])
                keys, packed = band_keys(mins), pack(mins)
                for i in range(lo, hi):
                    now = (grp[i], low[i], high[i])
                    if now != key:
                        close()
                        key, sides = now, ({}, {})
                    side = sides[0] if blk[i] == low[i] else sides[1]
                    side[int(node[i])] = (int(node[i]), sets[i - lo], keys[i - lo], packed[i - lo])
            if links:
                yield _links_batch(links)
                links.clear()
        close()
        if links:
            yield _links_batch(links)
    return run


def _links_batch(links):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])


def near_duplicate_links(docs: DataFrame, shingle: int = 5, threshold_pct: int = 80, text_col: str = "text",
                         id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: every row's class (doc_id, n_shingles, node), and confirmed links
    between classes that connect every near-duplicate group."""
    unnamed = F.lit(_NO_ID) + F.xxhash64(text_col).bitwiseAND(F.lit((1 << 43) - 1))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), unnamed).alias("doc_id"), F.col(text_col).alias("text"))
    sketch = materialize(own.mapInArrow(_sketcher(shingle), _SKETCH), "sketch")
    # a class of equal sets is named by its least doc_id
    classes = sketch.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"))
    classes = materialize(classes, "classes")
    # the rows that name their class, by id and set: copies of one text are different ids
    first = materialize(sketch.where("n_shingles > 0").select("set_a", "set_b", "doc_id", "n_shingles", "bands")
                        .join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", "set_a", "set_b"], "left_semi")
                        .select(F.col("doc_id").alias("node"), "n_shingles", "bands"), "first")
    keys = first.select("node", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    stars = keys.join(buckets.select("band", "a"), "band").where("node <> a").select("a", F.col("node").alias("b"))
    groups = connected_components(stars)
    # blocks: each coarse group is cut so that a block holds about BLOCK_SHINGLES hashes
    sized = groups.join(first.groupBy("node").agg(F.max("n_shingles").alias("n")), "node")
    cuts = sized.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS)).cast("int").alias("blocks"))
    placed = materialize(sized.join(cuts, "component")
                         .select("node", F.col("component").alias("grp"), "blocks",
                                 F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("blk")), "blocks")
    texts = own.join(placed, F.col("doc_id") == F.col("node"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                         lambda o: F.struct(F.least(o, F.col("blk")).alias("low"), F.greatest(o, F.col("blk")).alias("high")))
    work = (texts.select("grp", "blk", "node", "text", F.explode(others).alias("p"))
            .select("grp", "blk", "node", "text", "p.low", "p.high"))
    work = work.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high")
    links = work.mapInArrow(_linker(shingle, threshold_pct), _LINK)
    full = sketch.select("doc_id", "n_shingles", "set_a", "set_b")
    named = join_unique(full.where("n_shingles > 0"), classes, ["set_a", "set_b"]).unionByName(full.where("n_shingles = 0"), allowMissingColumns=True)
    members = (named
               .select(F.when(F.col("doc_id") < F.lit(_NO_ID), F.col("doc_id")).alias("doc_id"), "n_shingles", "node"))
    return members, links


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold_pct: int = 80, text_col: str = "text",
                    id_col: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (least doc_id reachable), ``kept``."""
    members, links = near_duplicate_links(docs, shingle, threshold_pct, text_col, id_col)
    named = connected_components(links).select(F.col("node"), F.col("component"))
    out = members.join(named, "node", "left")
    least = F.coalesce("component", "node", "doc_id")
    component = F.when(least < F.lit(_NO_ID), least)
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, threshold_pct: int = 80, text_col: str = "text",
                id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, rows with a null id where no
    named document is like them."""
    marks = near_duplicates(docs, shingle, threshold_pct, text_col, id_col)
    gone = materialize(marks.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def annotate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id`` and ``kept`` joined on by its id column."""
    key = options.get("id_col", "doc_id")
    marks = near_duplicates(docs, **options).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "_id")
    base = without(docs, "n_shingles", "component_id", "kept")
    return base.join(marks, base[key].eqNullSafe(F.col("_id")), "left").drop("_id")
