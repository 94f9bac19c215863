"""Benchmark decontamination: a broadcast set of test n-grams scans every training text.

The benchmark's windows (``window`` consecutive words; a shorter item is one window) become a
hash set that is broadcast in blocks of bounded size: of at most 16 MB of distinct texts and ids, in arrays of
about five times that.  Each text is tokenised once per block,
its windows are looked up by hash and every hit is verified word by word, byte by byte.  Rows
never move: the scan is one narrow pass per block.  A task holds the blocks of all passes at once, one Python
worker each, so a benchmark of several hundred MB wants larger executors.

Defined cases: a null or wordless text has no words and no hits; an item without words is
ignored; repeated items and repeated rows are handled row by row; an empty benchmark hits
nothing; a null ``item_id`` still marks words but is not listed.  Input columns that clash with
the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castplan.llm import textwords as tw
from castplan.llm.shared import materialize, text_chunks, without

#: Documented bound on the benchmark bytes held by one broadcast block.
BLOCK_BYTES = 16 << 20
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SCAN_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(_SPAN)),
               T.StructField("hit_items", T.ArrayType(T.StringType()))]


class WindowSet:
    """The windows of one block of benchmark texts, as sorted arrays: about 30 bytes a word.

    ``items``: ``(item ids, text)``.  A window is kept as the place of its first word in the texts' words.
    """

    def __init__(self, items: list, window: int):
        raw = [(text or "").encode("utf-8") for _, text in items]
        self.owners = [sorted({str(i) for i in ids if i is not None}) for ids, _ in items]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        del raw
        starts, ends, first = tw.words(data, offsets, tw.ALNUM_WORDS)
        low = tw.ALNUM_WORDS[1][data]
        hashes = tw.span_hash(tw.prefix_hash(low), starts, ends)
        # the distinct words, spelled by their first occurrence
        self.word_hash, at, ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.word_id = np.arange(len(at))
        n = ends[at] - starts[at]
        self.offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        self.letters = low[np.repeat(starts[at] - self.offsets[:-1], n) + np.arange(self.offsets[-1])]
        self.ids = ids.astype(np.int32)
        text_of = np.searchsorted(first, np.arange(len(hashes)), "right") - 1
        words = np.diff(first)
        self.lengths = []
        for size in np.unique(np.minimum(words[words > 0], window)).tolist():
            rolled = tw.ngrams(hashes, size)
            place = np.arange(len(rolled))
            left = first[text_of[:len(rolled)] + 1] - place  # words from here to the text's end
            whole = left >= size if size == window else (left == size) & (words[text_of[:len(rolled)]] == size)
            place = place[whole].astype(np.int32)
            keys, where, slot = np.unique(rolled[place], return_index=True, return_inverse=True)
            # the texts of every window, as runs
            by = np.argsort(slot, kind="stable")
            runs = np.searchsorted(slot[by], np.arange(len(keys) + 1))
            few = np.zeros(1 << 20, bool)
            few[keys & np.uint64((1 << 20) - 1)] = True
            self.lengths.append((size, keys, place[where], (runs, text_of[place[by]].astype(np.int32)), few))

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """``(first word of each text, hit flag of each word, [(text, owners), ...], starts, ends)``."""
        hashes, starts, ends, first = tw.word_hashes(data, offsets, tw.ALNUM_WORDS)
        edges = np.zeros(len(hashes) + 1, np.int64)
        found = []
        low = None
        for size, keys, place, owners, few in self.lengths:
            rolled = tw.ngrams(hashes, size)
            at = np.flatnonzero(few[rolled & np.uint64((1 << 20) - 1)])
            if not len(at):
                continue
            slot = np.searchsorted(keys, rolled[at])
            slot[slot == len(keys)] = 0
            doc = np.searchsorted(first, at, "right") - 1
            same = (keys[slot] == rolled[at]) & (at + size <= first[np.minimum(doc + 1, len(first) - 1)])
            at, slot, doc = at[same], slot[same], doc[same]
            if not len(at):
                continue
            if low is None:
                low = tw.ALNUM_WORDS[1][data]
            ok = self._verified(low, starts, ends, at, slot, size, place)
            at, slot, doc = at[ok], slot[ok], doc[ok]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + size, -1)
            runs, texts = owners
            for p in np.unique(doc * len(keys) + slot).tolist():
                k = p % len(keys)
                found.append((p // len(keys), {i for t in np.unique(texts[runs[k]:runs[k + 1]]).tolist() for i in self.owners[t]}))
        return first, np.cumsum(edges[:-1]) > 0, found

    def _verified(self, low, starts, ends, at, slot, size, places) -> np.ndarray:
        """Whether each hit has the same words, byte for byte."""
        used, back = np.unique((at[:, None] + np.arange(size)).ravel(), return_inverse=True)
        n = ends[used] - starts[used]
        want = self.ids[(places[slot][:, None] + np.arange(size)).ravel()]
        # every distinct text word against the benchmark word that its hash names
        place = np.searchsorted(self.word_hash, self._rehash(low, starts[used], ends[used]))
        place[place == len(self.word_hash)] = 0
        named = self.word_id[place]
        good = (self.offsets[named + 1] - self.offsets[named]) == n
        if good.any():
            g = np.flatnonzero(good)
            step = np.arange(int(n[g].sum())) - np.repeat(np.cumsum(n[g]) - n[g], n[g])
            equal = low[np.repeat(starts[used[g]], n[g]) + step] == self.letters[np.repeat(self.offsets[named[g]], n[g]) + step]
            good[g] = np.logical_and.reduceat(equal, np.cumsum(n[g]) - n[g])
        return ((named[back] == want) & good[back]).reshape(-1, size).all(axis=1)

    @staticmethod
    def _rehash(low, starts, ends):
        return tw.span_hash(tw.prefix_hash(low), starts, ends)


def benchmark_blocks(bench: DataFrame, window: int, text_col: str, id_col: str, block_bytes: int) -> list:
    """The benchmark as broadcast window sets of at most about ``block_bytes`` of texts and ids each.

    Equal texts are one text with several ids, so that a repeated item fills no block.  A block is read
    by the driver on its own and dropped there when it is broadcast.
    """
    spark = bench.sparkSession
    ids = F.collect_set(F.col(id_col).cast("string")).alias("ids")
    texts = materialize(bench.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(ids), "benchmark")
    size = F.octet_length("text") + F.aggregate("ids", F.lit(0), lambda a, i: a + F.octet_length(i))
    total = texts.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-2 * int(total) // block_bytes)) if total > block_bytes else 1
    blocks = []
    for k in range(n):
        part = texts if n == 1 else texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        blocks.append(spark.sparkContext.broadcast(WindowSet([(r["ids"], r["text"]) for r in part.select("ids", "text").collect()], window)))
    return blocks


def scan(docs: DataFrame, bench: DataFrame, window: int = 10, text_col: str = "text",
         bench_text: str = "text", bench_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` plus ``n_words``, ``hit_spans`` (word ranges, end
    exclusive, disjoint) and ``hit_items`` (sorted, distinct).

    Works the same at any benchmark size: a benchmark over ``block_bytes`` is scanned in several
    blocks, each within the bound, whose spans and items are merged row by row.
    """
    out = without(docs, *[f.name for f in SCAN_FIELDS])
    for k, block in enumerate(benchmark_blocks(bench, window, bench_text, bench_id, block_bytes)):
        base = T.StructType([f for f in out.schema.fields if k == 0 or f.name not in {x.name for x in SCAN_FIELDS}])
        out = out.mapInArrow(_scanner(block, text_col, [f.name for f in base.fields]), T.StructType(base.fields + SCAN_FIELDS))
    return out


def _scanner(block, text_col: str, keep: list):
    def run(batches):
        for batch in batches:
            old = [batch.column(f.name).to_pylist() if f.name in batch.schema.names else None for f in SCAN_FIELDS]
            counts, spans, items = [], [], []
            for lo, hi, data, offsets in text_chunks(batch.column(text_col)):
                first, hit, found = block.value.scan(data, offsets)
                own: dict = {}
                for doc, owners in found:
                    own.setdefault(doc, set()).update(owners)
                for i in range(hi - lo):
                    a, b = int(first[i]), int(first[i + 1])
                    counts.append(b - a)
                    flags = hit[a:b]
                    earlier = old[1][lo + i] if old[1] else None
                    if earlier:
                        flags = flags.copy()
                        for s in earlier:
                            flags[s["start"]:s["end"]] = True
                    if flags.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                    else:
                        spans.append([])
                    items.append(sorted(own.get(i, set()) | set(old[2][lo + i] if old[2] else ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(counts, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(items, pa.list_(pa.string()))], names=keep + [f.name for f in SCAN_FIELDS])
    return run


def span_words(spans="hit_spans"):
    """Number of words that spans cover."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """``docs`` without its contamination, in the columns of ``docs``.

    ``remove="documents"`` drops every row with a verified hit; ``remove="spans"`` cuts the hit
    words out of the text (from the first byte of a span to the last) and keeps the row.
    """
    names = docs.columns
    found = scan(docs, bench, **options)
    if remove == "documents":
        return found.where(F.size("hit_spans") == 0).select(names)
    text = options.get("text_col", "text")
    fields = found.schema.fields

    def cut(batches):
        for batch in batches:
            texts, spans = batch.column(text).to_pylist(), batch.column("hit_spans").to_pylist()
            for i, own in enumerate(spans):
                if own:
                    data = np.frombuffer(texts[i].encode("utf-8"), np.uint8)
                    starts, ends, _ = tw.words(data, np.array([0, len(data)]), tw.ALNUM_WORDS)
                    keep = np.ones(len(data), bool)
                    for s in own:
                        keep[starts[s["start"]]:ends[s["end"] - 1]] = False
                    texts[i] = data[keep].tobytes().decode("utf-8")
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(texts, pa.string()))

    return found.mapInArrow(cut, T.StructType(fields)).select(names)
