"""Byte-level BPE by a global shuffle of distinct words.

``encode`` scans the texts in blocks of whole texts.  A block's pre-tokens are numbered by word, in
order of first occurrence: the numbers in text order are its positions, and every distinct word of
the block becomes one row (word, block, number), the block's pre-aggregated occurrences.  These rows
are shuffled and sorted by word, so a task meets all rows of a word next to each other, merges its
bytes by rank once, and hands the ids to each row.  The rows then go back to their blocks, packed, and
ids are put in place by position.  A word has at most one row per block, so that a word that is a third of
all pre-tokens is a row in a few hundred thousand.

Positions travel once: a second scan of the same blocks sends them straight to the blocks' tasks.  A
block's rows carry a digest of its texts; if the scans differ (an input whose order changed), the task
fails rather than mixing them.  Inputs whose plan has an exchange are therefore written first.

``decode`` joins the token-byte table, which is as large as the vocabulary and is sent to every
task, to each id in place.

Defined cases: null and empty texts have no ids and decode to no bytes; text that the pattern
doesn't match is left out, as ``encode_ordinary`` of such an encoding does; special tokens are
ordinary text; a text longer than a block is a block; repeated rows are encoded as often as they occur; an id
outside the vocabulary makes ``decoded`` null.  Extra columns pass through; columns that clash with
the added ones are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import operator
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castplan.llm.shared import fixed_rows, without

#: Pre-tokens after which a block ends; bounds a block's memory (about 20 MB of text).
BLOCK_TOKENS = 1 << 22
#: Pre-tokens whose ids are put in place at a time.
PLACED_TOKENS = 1 << 19
#: Rows of encoded words that a task holds to pack those of a block together.
PACKED_ROWS = 1 << 18
#: Words of more bytes are merged with a heap.
HEAP_BYTES = 40


class Vocabulary:
    """Merge ranks (the ids) by token bytes, and the pre-token pattern."""

    def __init__(self, ranks: dict, pattern: str):
        self.ranks, self.pattern = ranks, pattern

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a file of lines ``base64(token) rank``, read on the driver."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}, pattern)

    def tokens(self) -> list:
        """Token bytes by id; None where an id is free."""
        out = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            out[i] = token
        return out


def plain_pattern(pattern: str, most: int) -> str | None:
    """``pattern`` with ranges of code points up to ``most`` for its letter, number and white-space classes, which
    the standard engine then finds without a Unicode property lookup; None if it has other properties."""
    text = "".join(map(chr, (c for c in range(most + 1) if not 0xD800 <= c < 0xE000)))

    def ranges(name):
        points = [ord(c) for c in regex.findall(name, text)]
        starts = [c for i, c in enumerate(points) if not i or points[i - 1] != c - 1]
        ends = [c for i, c in enumerate(points) if i + 1 == len(points) or points[i + 1] != c + 1]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))

    known = {name: ranges(name) for name in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((n for n in (*known, r"\S", "\\") if pattern.startswith(n, i)), pattern[i])
        if name in known:
            out.append(known[name] if inside else f"[{known[name]}]")
        elif name == r"\S" and not inside:
            out.append(f"[^{known[chr(92) + 's']}]")
        elif name in (r"\S", "\\") or pattern.startswith("(?", i) and not pattern.startswith(("(?!", "(?=", "(?:"), i):
            return None
        else:
            inside = name == "[" or inside and name != "]"
            out.append(name)
        i += len(name)
    return "".join(out)


class Finder:
    """All matches of a pattern; texts of few code points take the plain forms of it, with equal results."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        self.plain = [re.compile(p) if (p := plain_pattern(pattern, most)) else self.full for most in (0x7F, 0xFFFF)]

    def __call__(self, text: str):
        if text.isascii():
            form = self.plain[0]
        else:
            form = self.plain[1] if len(text.encode("utf-16-le")) == 2 * len(text) else self.full
        # of long texts not all matches are held
        return form.findall(text) if len(text) < 1 << 20 else map(operator.itemgetter(0), form.finditer(text))


def merge(word: bytes, ranks: dict) -> list:
    """Ids of one word: again and again the adjacent pair of least rank, the leftmost first, becomes one."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > HEAP_BYTES:
        return _merge_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b, _NONE) for a, b in itertools.pairwise(parts)]
    while pairs:
        least = min(pairs)
        if least == _NONE:
            break
        i = pairs.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
    return [ranks[p] for p in parts]


_NONE = 1 << 62


def _merge_long(word: bytes, ranks: dict) -> list:
    """``merge`` for long words: pairs in a heap by (rank, place), parts in a linked list of ends."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a place

    def pair(i):
        j = end[i]
        return ranks.get(word[i:end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of its parts has grown
        j = end[i]
        alive[j], end[i] = False, end[j]
        if end[i] < n:
            before[end[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, end[end[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def _blocks(batches, pattern: str):
    """``(block, digest, words, code arrays, rows)`` of this task's texts; ``rows`` are (batch, from, to)."""
    find = Finder(pattern)
    task = TaskContext.get()
    first = (task.partitionId() if task else 0) << 32

    def begin():
        return defaultdict(itertools.count().__next__), [], [], hashlib.blake2b(digest_size=16)

    numbers = itertools.count(first)
    words, codes, rows, digest = begin()
    n = 0
    for batch in batches:
        lo = 0
        for i, text in enumerate(batch.column(0)):
            text = text.as_py() or ""
            digest.update(text.encode() + b"\xff")
            codes.append(np.fromiter(map(words.__getitem__, find(text)), np.uint32))
            n += len(codes[-1])
            if n >= BLOCK_TOKENS:
                rows.append((batch, lo, i + 1))
                yield next(numbers), digest.digest(), list(words), codes, rows
                words, codes, rows, digest = begin()
                n, lo = 0, i + 1
        if lo < batch.num_rows:
            rows.append((batch, lo, batch.num_rows))
    if rows:
        yield next(numbers), digest.digest(), list(words), codes, rows


def _explode(pattern: str):
    """Rows (word, block, number); the digest is the row without a word."""
    def run(batches):
        for block, digest, words, _, _ in _blocks(batches, pattern):
            yield pa.RecordBatch.from_arrays([pa.array([None]), pa.array([block]), pa.array([-1], pa.int32()), pa.array([digest])], schema=_WORDS_ARROW)
            for lo in range(0, len(words), 1 << 16):
                part = words[lo:lo + (1 << 16)]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(np.full(n, block)), pa.array(np.arange(lo, lo + n, dtype=np.int32)),
                                                  pa.nulls(n, pa.binary())], schema=_WORDS_ARROW)
    return run


_WORDS = "word string, block long, number int, ids binary"
_WORDS_ARROW = pa.schema([("word", pa.string()), ("block", pa.int64()), ("number", pa.int32()), ("ids", pa.binary())])


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, all first bytes first, which compresses well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _values(planes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()


def _encode_words(ranks: dict):
    """Gives sorted words their ids; each distinct word is merged once.  The rows of a block that come
    together in a task go back in one piece: its word numbers, the ids of each, the ids in that order."""
    def pack(held):
        block, number = (np.concatenate([h[c] for h in held]) for c in (0, 1))
        raw = pa.concat_arrays([h[2] for h in held])
        starts = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64) // 4
        flat = np.frombuffer(raw.buffers()[2], "<u4")
        by = np.lexsort((number, block))
        block, number, sizes = block[by], number[by], np.diff(starts)[by]
        to = np.cumsum(sizes)
        flat = flat[np.repeat(starts[:-1][by] - to + sizes, sizes) + np.arange(to[-1])]
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        ends = np.concatenate([[0], to])
        pieces = [_planes(np.diff(number[a:b], prepend=0)) + _planes(sizes[a:b]) + _planes(flat[ends[a]:ends[b]]) for a, b in itertools.pairwise(cuts)]
        n = len(pieces)
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(np.full(n, PIECE, np.int32)), pa.array(np.diff(cuts).astype(np.int32)),
                                           pa.array(pieces, pa.binary())], names=_PIECES_NAMES)

    def run(batches):
        last, last_ids = None, None
        held, rows = [], 0
        for batch in batches:
            seal = batch.filter(batch.column("word").is_null())
            if seal.num_rows:
                yield pa.RecordBatch.from_arrays([seal.column("block"), pa.array(np.full(len(seal), SEAL, np.int32)), seal.column("number"), seal.column("ids")], names=_PIECES_NAMES)
                batch = batch.filter(batch.column("word").is_valid())
            if not batch.num_rows:
                continue
            words = batch.column("word").dictionary_encode()
            ids = []
            for word in words.dictionary.to_pylist():
                if word != last:
                    last, last_ids = word, np.array(merge(word.encode(), ranks), "<u4").tobytes()
                ids.append(last_ids)
            held.append((batch.column("block").to_numpy(), batch.column("number").to_numpy(), pa.array(ids, pa.binary()).take(words.indices)))
            rows += batch.num_rows
            if rows >= PACKED_ROWS:
                yield pack(held)
                held, rows = [], 0
        if rows:
            yield pack(held)
    return run


#: Order of a block's rows: positions, digest, pieces of ids.
HEAD, SEAL, PIECE = 0, 1, 2
_PIECES = "block long, kind int, n int, data binary"
_PIECES_NAMES = ["block", "kind", "n", "data"]


def _positions(pattern: str, keep: list, arrow: pa.Schema):
    """One row per block: its positions, the pre-tokens of each text, the texts' other columns, the digest."""
    def run(batches):
        for block, digest, words, codes, rows in _blocks(batches, pattern):
            columns = [pa.concat_arrays([b.column(c).slice(lo, hi - lo) for b, lo, hi in rows]) for c in range(1, len(keep) + 1)]
            columns.append(pa.array(np.array([len(c) for c in codes], np.int64)))
            texts = pa.StructArray.from_arrays(columns, fields=list(arrow.field("texts").type.value_type))
            one = pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), texts)
            raw = pa.compress(_planes(np.concatenate(codes)), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([HEAD], pa.int32()), pa.array([len(words)], pa.int32()), pa.array([raw], pa.binary()),
                                              pa.array([digest], pa.binary()), one], schema=arrow)
    return run


class _Block:
    """The rows of one block on their way back together."""

    def __init__(self):
        self.head, self.seal, self.pieces, self.found = None, None, [], 0

    def add(self, row: dict) -> None:
        if row["kind"] == HEAD:
            self.head = row
        elif row["kind"] == SEAL:
            self.seal = row["data"]
        else:
            n = row["n"]
            raw = memoryview(row["data"])
            sizes = _values(raw[4 * n:], n).astype(np.int64)
            self.pieces.append((np.cumsum(_values(raw, n)).astype(np.int64), sizes, _values(raw[8 * n:], int(sizes.sum()))))
            self.found += n

    def words(self):
        """``(first id, ids)`` of the block's words by number, and all ids."""
        if self.head is None or self.seal != self.head["digest"] or self.found != self.head["n"]:
            raise RuntimeError("a block of texts changed between two scans of the input; write the input first")
        sizes = np.zeros(self.found, np.int64)
        for number, n, _ in self.pieces:
            sizes[number] = n
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.zeros(starts[-1], "<u4")
        for number, n, ids in self.pieces:
            flat[np.repeat(starts[number] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return starts, sizes, flat

    def texts(self, keep: list):
        """The block's texts, with the ids of their pre-tokens in place."""
        starts, lengths, ids = self.words()
        self.pieces = []
        columns = self.head["texts"].flatten()
        sizes, columns = columns[-1].to_numpy(), columns[:-1]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        codes = _values(pa.decompress(self.head["data"], 4 * int(ends[-1]), codec="zstd", asbytes=True), int(ends[-1]))
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PLACED_TOKENS, "right")) - 1)
            out, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
            for part in range(ends[lo], ends[hi], PLACED_TOKENS):  # a long text in pieces
                own = codes[part:min(part + PLACED_TOKENS, ends[hi])]
                n = lengths[own]
                to = np.cumsum(n)
                out.append(ids[np.repeat(starts[own] - to + n, n) + np.arange(to[-1])])
                counts.append(n)
            flat, total = np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            cut = total[ends[lo:hi + 1] - ends[lo]]
            raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in columns], raw, pa.array(np.diff(cut))], names=[*keep, *ADDED])
            lo = hi


def _reassemble(keep: list):
    """Streams rows sorted by (block, kind)."""
    def run(batches):
        at, block = None, None
        for batch in batches:
            texts = batch.column("texts")
            for i, (k, kind, n, data, digest) in enumerate(zip(*[batch.column(c) for c in ("block", "kind", "n", "data", "digest")], strict=True)):
                if at != k.as_py():
                    if block:
                        yield from block.texts(keep)
                    at, block = k.as_py(), _Block()
                block.add({"kind": kind.as_py(), "n": n.as_py(), "data": data.as_buffer(), "digest": digest.as_py(), "texts": texts[i].values}
                          if kind.as_py() != SEAL else {"kind": SEAL, "data": data.as_py()})
        if block:
            yield from block.texts(keep)
    return run


ADDED = ["ids", "n_tokens"]


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep: list | None = None) -> DataFrame:
    """``keep`` columns (all by default), ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    docs = fixed_rows(docs.select(F.col(text_col).alias("_text"), *keep))
    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    texts = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)], T.StructField("size", T.LongType())])
    block = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType()),
                          T.StructField("digest", T.BinaryType()), T.StructField("texts", T.ArrayType(texts))])
    words = docs.select("_text").mapInArrow(_explode(vocabulary.pattern), _WORDS).repartition("word").sortWithinPartitions("word")
    encoded = words.mapInArrow(_encode_words(vocabulary.ranks), _PIECES)
    positions = docs.mapInArrow(_positions(vocabulary.pattern, keep, to_arrow_schema(block)), block)
    rows = positions.unionByName(encoded, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    out = T.StructType([*fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_reassemble(keep), out)


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of the ids of ``ids_col`` (little-endian unsigned 32-bit integers)."""
    base = without(df, "decoded")
    table, names = vocabulary.tokens(), base.columns

    def run(batches):
        for batch in batches:
            out = []
            for ids in batch.column(ids_col):
                try:
                    out.append(None if not ids.is_valid else b"".join(map(table.__getitem__, np.frombuffer(ids.as_buffer(), "<u4").tolist())))
                except (IndexError, TypeError):
                    out.append(None)  # not an id of the vocabulary
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("decoded", T.BinaryType())]))
