"""Line dedup by content-defined chunks of lines.

A text is cut at newlines.  A rolling hash over the hashes of ``WINDOW`` consecutive lines with words
chooses chunk boundaries: forward, a line ends a chunk if the hash of the window that ends with it is
even; backward, a line starts one if the hash of the window that starts with it is odd.  From every line
with words a chunk runs forward to its first boundary, and one runs back.  As usual in content-defined
chunking there is a least and a greatest size: a chunk has ``MIN_WORDS`` words and two lines with words (or a
line of ``LONG_WORDS`` words) at least, and is cut at ``MAX_WORDS`` words or where its text ends.

A boundary is decided by lines of the chunk only (a chunk of one line by the hash of that line), so the same
lines give the same chunks whatever stands around them.  Of two neighbouring lines that are long enough,
either the forward chunk of the first or the backward chunk of the second is just those two, as one hash is even
or odd; and a passage of ``MAX_WORDS`` words can't outrun its chunks.  So a repeated passage is covered
line by line to its ends: every repeated chunk is found in every text, and neighbouring chunks share lines.

A first pass counts chunk hashes (aggregated map side); only chunks whose hash repeats are then
grouped by their bytes, which is the byte comparison.  Of each repeated chunk the first place (least
doc_id, then place in the text) stays; the lines of all others go.  The first place of a line is
in first places only, so every distinct line stays at least once.

Defined cases: null text stays null and an empty text stays empty; a text of which no more than
empty lines is left becomes empty; a line of fewer than ``LONG_WORDS`` words that repeats between
other neighbours stays; ``n_removed_chunks`` counts overlapping chunks; repeated rows (same doc_id and text) are one document listed again and get the same
decisions; a null doc_id counts as the last document.  Extra columns pass through; columns that
clash with the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castplan.llm import textwords as tw
from castplan.llm.shared import materialize, text_chunks, without

#: Lines of the rolling hash; words of a line that is a chunk by itself; least and greatest words of a chunk.
WINDOW, LONG_WORDS, MIN_WORDS, MAX_WORDS = 2, 32, 10, 50
_STEP = np.uint64(0xD1342543DE82EF95)
#: Bound on the hashes of repeated chunks (16 bytes each) that are broadcast.
BROADCAST_HASHES = 1_000_000
_LINES = tw.byte_table([10], lower=False)


def line_spans(data: np.ndarray, offsets: np.ndarray):
    """``(start, end, first)`` of all lines, newline not included; an empty text has no line."""
    newline = np.flatnonzero(data == 10)
    filled = offsets[1:] > offsets[:-1]
    start = np.unique(np.concatenate([newline + 1, offsets[:-1][filled]]))
    # a newline that ends its text opens no line of the next text
    inner = np.searchsorted(offsets, start, "right") - 1
    start = start[start < len(data)]
    inner = inner[:len(start)]
    stop = np.concatenate([start[1:], [len(data)]]) if len(start) else start
    stop = np.minimum(stop, offsets[inner + 1]) if len(start) else stop
    end = stop - (data[np.maximum(stop - 1, 0)] == 10) if len(start) else stop
    return start, np.maximum(end, start), np.searchsorted(start, offsets)


def rolling(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """At every line the polynomial hash of the ``window`` lines that end with it, modulo 2^64: the line that leaves
    the window is taken off, the new one added."""
    weighted = np.zeros(len(hashes), np.uint64)
    for back in range(min(window, len(hashes))):  # the same sums, term by term
        weighted[back:] += hashes[:len(hashes) - back] * _STEP ** np.uint64(back)
    return tw.mix(weighted)


def _next(flags: np.ndarray) -> np.ndarray:
    """At every place the first place from there on that is flagged (the length if none)."""
    at = np.where(flags, np.arange(len(flags)), len(flags))
    return np.append(np.minimum.accumulate(at[::-1])[::-1], len(flags))


def chunk_table(data: np.ndarray, offsets: np.ndarray, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS):
    """Removable chunks: ``(text, first byte, end byte, chunk number, lines, hash)`` as arrays, by first
    byte, then by end byte.

    ``end byte`` includes the newline that ends the chunk's last line, if any; the hash covers
    the bytes without it, so a passage at the end of a text matches one in the middle.
    """
    start, end, first = line_spans(data, offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none.astype(np.uint64)
    prefix = tw.prefix_hash(data)
    word_start, _, _ = tw.words(data, offsets, tw.SPACE_WORDS)
    n_words = np.searchsorted(word_start, end) - np.searchsorted(word_start, start)
    doc = np.searchsorted(first, np.arange(len(start)), "right") - 1
    at = np.flatnonzero(n_words)  # lines without words start and end no chunk
    n, words = len(at), n_words[at]
    own = tw.span_hash(prefix, start[at], end[at])
    even = rolling(own) % 2 == 0
    alone = tw.mix(own) % 2 == 0  # a chunk of one line has no other to go by
    size, long = (np.concatenate([[0], np.cumsum(x)]) for x in (words, words >= long_words))
    begin, after = np.searchsorted(at, first[doc[at]]), np.searchsorted(at, first[doc[at] + 1])  # of each line's text
    here = np.arange(n)
    least = max(min_words, 1)

    def forward(total, more):  # the first line by which the total has grown by so much since before line ``here``
        return np.searchsorted(total, total[here] + more) - 1

    def back(total, more):  # the last line from which it grows by so much up to line ``here``
        return np.searchsorted(total, total[here + 1] - more, "right") - 1

    # chunks that run forward: from the least end to the first even window, the greatest size or the text's end
    low = np.maximum(forward(size, least), np.minimum(here + 1, forward(long, 1)))
    cut = _next(even)
    found = np.where((low == here) & alone, here, cut[np.minimum(np.maximum(low, here + 1), n)])
    last = np.minimum(found, np.minimum(np.maximum(forward(size, max_words), low), after - 1))
    ahead = low < after
    # chunks that run back, cut where a window starts that is odd
    high = np.minimum(back(size, least), np.maximum(here - 1, back(long, 1)))
    odd = np.append(~even[1:], False)
    before = n - 1 - _next(odd[::-1])  # the last odd place up to n - 1 - index, or -1
    found = np.where((high == here) & ~alone, here, before[np.clip(n - 1 - np.minimum(high, here - 1), 0, n)])
    head = np.maximum(found, np.maximum(np.minimum(back(size, max_words), high), begin))
    behind = high >= begin
    a, b = np.concatenate([here[ahead], head[behind]]), np.concatenate([last[ahead], here[behind]])
    both = np.unique(at[a] * len(start) + at[b])
    a, b = both // len(start), both % len(start)
    number = np.arange(len(a)) - np.searchsorted(a, first[doc[a]])
    stop = np.minimum(end[b] + 1, offsets[doc[b] + 1])
    return doc[a], start[a], stop, number, b - a + 1, tw.span_hash(prefix, start[a], end[b])


_KEYS = T.StructType([T.StructField("doc_key", T.LongType()), T.StructField("text_key", T.LongType()),
                      T.StructField("place", T.IntegerType()), T.StructField("chunk_hash", T.LongType())])
_BYTES = T.StructType(_KEYS.fields + [T.StructField("chunk", T.BinaryType())])


def _chunker(options: dict, with_bytes: bool):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                doc, start, stop, number, _, hashes = chunk_table(data, offsets, **options)
                if batch.num_columns > 3:  # named places only
                    at = np.searchsorted(doc, np.arange(hi - lo + 1))
                    named = [at[i] + np.sort(places) for i, places in enumerate(batch.column(3).slice(lo, hi - lo).to_pylist())]
                    doc, start, stop, number, hashes = (x[np.concatenate(named)] for x in (doc, start, stop, number, hashes))
                keys = [batch.column(c).slice(lo, hi - lo).take(pa.array(doc)) for c in (0, 1)]
                cols = [*keys, pa.array(number.astype(np.int32)), pa.array(hashes.view(np.int64))]
                if with_bytes:
                    raw = data.tobytes()
                    cols.append(pa.array([raw[a:b].removesuffix(b"\n") for a, b in zip(start, stop, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in (_BYTES if with_bytes else _KEYS).fields])
    return run


def repeated_places(docs: DataFrame, text_col: str, options: dict) -> DataFrame:
    """``(doc_key, text_key, gone)``: the places of the chunks to remove from each document."""
    own = docs.select("doc_key", "text_key", text_col)
    keys = materialize(own.mapInArrow(_chunker(options, False), _KEYS), "chunk-keys")
    twice = materialize(keys.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_hash"), "twice")
    few = twice.count() <= BROADCAST_HASHES
    twice = F.broadcast(twice) if few else twice
    again = keys.join(twice, "chunk_hash", "left_semi")
    if few:  # few enough hashes go to the bytes by broadcast
        chunks = own.mapInArrow(_chunker(options, True), _BYTES).join(twice, "chunk_hash", "left_semi")
    else:  # beyond that the texts go to their repeated places, and only those give their bytes
        again = materialize(again, "again")
        places = again.groupBy("doc_key", "text_key").agg(F.collect_set("place").alias("places"))
        chunks = own.join(places, ["doc_key", "text_key"]).mapInArrow(_chunker(options, True), _BYTES)
    # equal bytes, not equal hashes, make a repeated chunk; copies meet already inside a task
    first = chunks.groupBy("chunk_hash", "chunk").agg(F.min(F.struct("doc_key", "text_key", "place")).alias("first"))
    # a place goes if its hash repeats and it isn't the first of its bytes
    gone = again.join(first.select("first.*"), ["doc_key", "text_key", "place"], "left_anti")
    return gone.groupBy("doc_key", "text_key").agg(F.sort_array(F.collect_set("place")).alias("gone"))


ADDED = ["n_lines", "n_removed_lines", "n_removed_bytes", "n_removed_chunks"]
_COUNTS = [T.StructField(c, T.LongType()) for c in ADDED]


def _remover(text_col: str, keep: list, options: dict):
    def run(batches):
        for batch in batches:
            texts = batch.column(text_col)
            gone = batch.column("_gone").to_pylist()
            out, counts = [], []
            for lo, hi, data, offsets in text_chunks(texts):
                raw = data.tobytes()
                line, _, first = line_spans(data, offsets)
                doc, start, stop, number, _, _ = chunk_table(data, offsets, **options)
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    places = set(gone[lo + i] or ())
                    cut = [j for j in range(at[i], at[i + 1]) if number[j] in places] if places else []
                    removed = lines = 0
                    if cut:
                        parts, pos = [], a
                        for j in cut:
                            head, end = max(pos, int(start[j])), int(stop[j])
                            if end <= head:
                                continue  # inside one before it
                            parts.append(raw[pos:head])
                            removed += end - head
                            lines += int(np.searchsorted(line, end) - np.searchsorted(line, head))
                            pos = end
                        parts.append(raw[pos:b])
                        body = b"".join(parts)
                        if pos == b and raw[b - 1:b] != b"\n":
                            body = body.removesuffix(b"\n")  # the newline before a removed end
                        out.append(body.decode("utf-8") if body.strip(b"\n") else "")
                    else:
                        out.append(texts[lo + i].as_py())
                    counts.append((int(first[i + 1] - first[i]), lines, removed, len(cut)))
            cols = [pa.array(out, pa.string()) if c == text_col else batch.column(c) for c in keep]
            cols += [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(ADDED))]
            yield pa.RecordBatch.from_arrays(cols, names=keep + ADDED)
    return run


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with repeated chunks removed from the text, and ``n_lines`` (before), the removed
    lines and bytes and the number of removed chunks.

    ``options``: long_words, min_words, max_words.
    """
    base = without(docs, *ADDED)
    # ids order the documents; rows of one id are told apart by their text, repeated rows are not
    keys = {"_doc": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), "_text": F.xxhash64(text_col)}
    own = base.select(keys["_doc"].alias("doc_key"), keys["_text"].alias("text_key"), text_col)
    gone = repeated_places(own, text_col, options).withColumnsRenamed({"doc_key": "_doc", "text_key": "_text", "gone": "_gone"})
    fields = base.schema.fields
    keep = [f.name for f in fields]
    marked = base.withColumns(keys).join(gone, ["_doc", "_text"], "left")
    return marked.select(*keep, "_gone").mapInArrow(_remover(text_col, keep, options), T.StructType(fields + _COUNTS))
