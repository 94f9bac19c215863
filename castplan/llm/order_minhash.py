"""Order MinHash fingerprints.

The k-mers of a text are its runs of ``K`` words (shorter at its end).  Equal k-mers are numbered
by occurrence, numbered k-mers are hashed, and the hash space is cut into ``SLOTS`` parts, each a
sketch of its own (one-permutation form).  A sketch selects its two smallest numbered k-mers,
puts them back into text order and hashes that pair, so moving text changes a fingerprint as
replacing it does.  The likeness of two fingerprints is the share of equal sketches among those
that either text fills.

DataFrame functions only.  All steps stay inside one row's arrays: words are hashed once, packed
with their position into a long, and sorted twice as longs; no k-mer becomes a row or is shuffled.
Defined cases: null, empty and blank texts have no k-mer, an empty fingerprint, likeness 1 to each
other and 0 to any other; positions are kept for 2^24 words (beyond, order repeats from 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castplan.llm.shared import slices_for, without

K, SLOTS = 3, 64
_POS = (1 << 24) - 1
_STEPS = [1 << b for b in range(23, -1, -1)]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(hashed: Column, position: Column) -> Column:
    """39 bits of hash over 24 bits of position, as a positive long."""
    return F.shiftleft(F.shiftrightunsigned(hashed, 25), 24).bitwiseOR(position)


def _kmers(words: Column) -> Column:
    """Sorted longs (k-mer hash, position)."""
    def positions(h):
        return F.sort_array(F.transform(h, lambda x, i: _packed(
            F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)]), i.cast("long").bitwiseAND(F.lit(_POS)))))
    return let(F.transform(words, lambda w: F.xxhash64(w)), positions)


def _kmer(x: Column) -> Column:
    return F.shiftrightunsigned(x, 24)


def _numbered(kmers: Column) -> Column:
    """Sorted longs (hash of k-mer and occurrence number, position).

    Equal k-mers stand side by side in text order.  A first occurrence keeps its hash; one that
    repeats its left neighbour is hashed anew with its distance from the start of the run, which
    halving steps find.
    """
    def number(s):
        def one(x, j):
            start = F.aggregate(F.array(*[F.lit(b) for b in _STEPS]), j, lambda p, b: F.when(
                (p >= b) & (_kmer(F.get(s, p - b)) == _kmer(x)), p - b).otherwise(p))
            return F.when(_kmer(F.get(s, j - 1)) == _kmer(x), _packed(F.xxhash64(_kmer(x), j - start), x.bitwiseAND(F.lit(_POS)))).otherwise(x)
        again = F.exists(F.transform(s, lambda x, j: _kmer(F.get(s, j - 1)) == _kmer(x)), lambda r: r)
        return F.when(again, F.sort_array(F.transform(s, one))).otherwise(s)
    return let(kmers, number)


def _part(x: Column) -> Column:
    return F.shiftrightunsigned(x, 63 - (SLOTS.bit_length() - 1))


def _sketches(numbered: Column) -> Column:
    """Longs (part, hash of the part's least two in text order), sorted; empty parts are absent."""
    def least(t):
        return F.filter(t, lambda x, j: F.coalesce(_part(F.get(t, j - 2)) != _part(x), F.lit(True)))

    def pairs(chosen):
        def pair(x, j):
            y = F.get(chosen, j + 1)
            later = x.bitwiseAND(F.lit(_POS)) > y.bitwiseAND(F.lit(_POS))
            both = F.when(later, F.xxhash64(_kmer(y), _kmer(x))).otherwise(F.xxhash64(_kmer(x), _kmer(y)))
            tuple_hash = F.when(_part(y) == _part(x), both).otherwise(F.xxhash64(_kmer(x)))
            head = F.coalesce(_part(F.get(chosen, j - 1)) != _part(x), F.lit(True))
            return F.when(head, F.shiftleft(_part(x), 32).bitwiseOR(F.shiftrightunsigned(tuple_hash, 32)))
        return F.filter(F.transform(chosen, pair), lambda p: p.isNotNull())
    return let(let(numbered, least), pairs)


def sketches(text: Column) -> Column:
    """The fingerprint of a text as at most ``SLOTS`` longs."""
    words = F.when(text.rlike(r"[^ \t-\r]"), F.split(text, r"[ \t-\r]+"))
    return _sketches(_numbered(_kmers(F.coalesce(words, F.array().cast("array<string>")))))


def fingerprint(sketch: Column) -> Column:
    """Ten hex digits per sketch: the part of the hash space and the tuple's hash."""
    return F.array_join(F.transform(sketch, lambda s: F.lpad(F.lower(F.hex(s)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches among the parts that either text fills; 1 if both fill none."""
    filled = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda s: F.shiftrightunsigned(s, 32))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled.cast("double"))


def add_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every text; no shuffle."""
    return without(docs, out).withColumn(out, fingerprint(sketches(F.col(text_col))))


def with_next(docs: DataFrame, order_col: str, value: str, derived: dict, rows_per_slice: int = 2000) -> DataFrame:
    """``docs`` with the ``derived`` columns, and ``next_<name>`` of ``value`` and of each of them from
    the next row in descending ``order_col`` (ties by ``value``'s hash, nulls last; after the last
    row: the first), in one shuffle and without a window over the whole table.

    Rows are dealt to slices by quantiles of ``order_col``; every slice also gets a copy of the
    first row of the slice after it, so that its last row finds its next inside the slice.
    """
    rank = F.coalesce(F.col(order_col).cast("long"), F.lit(-(1 << 63)))
    tie = F.xxhash64(value)
    rows = docs.agg(F.count(F.lit(1))).first()[0]
    n = min(slices_for(rows, rows_per_slice), 4096)
    shares = [F.lit(i / n) for i in range(1, n)]
    cuts = sorted(set(docs.agg(F.percentile_approx(rank, F.array(*shares), F.lit(10 * n))).first()[0] or [])) if shares else []
    held = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>")
    # number of cuts below the rank, by halving steps
    steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length(), -1, -1)])
    slot = F.aggregate(steps, F.lit(0), lambda p, b: F.when((p + b <= len(cuts)) & (F.get(held, p + b - 1) < F.col("_rank")), p + b).otherwise(p))
    base = docs.withColumn("_rank", rank).withColumn("_tie", tie).withColumn("_slice", slot)
    # the first row of every slice, and the slice above it in which it is a guest (lowest: the top)
    tops = base.groupBy("_slice").agg(F.max(F.struct("_rank", "_tie")).alias("_top"))
    around = Window.orderBy("_slice")  # one row per slice
    tops = tops.select("_top", F.lead("_slice").over(around).alias("_up"), F.first("_slice").over(around).alias("_lowest"))
    tops = tops.select(F.col("_top._rank").alias("_rank"), F.col("_top._tie").alias("_tie"), F.coalesce("_up", "_lowest").alias("_host"))
    guests = (base.join(F.broadcast(tops), ["_rank", "_tie"]).dropDuplicates(["_host"])
              .withColumn("_slice", F.col("_host")).drop("_host").withColumn("_guest", F.lit(True)))
    order = Window.partitionBy("_slice").orderBy("_guest", F.col("_rank").desc(), F.col("_tie").desc())
    both = base.withColumn("_guest", F.lit(False)).unionByName(guests).withColumns(derived)
    both = both.withColumns({f"next_{v}": F.lead(v).over(order) for v in (value, *derived)})
    return both.where(~F.col("_guest")).drop("_rank", "_tie", "_slice", "_guest")


def edited_text(text: Column, following: Column) -> Column:
    """The last third (floor) of the code points replaced by the first as many of another text."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def edit_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row the fingerprints of its text and of its edited text, and their likenesses."""
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = with_next(own, id_col, "text", {"sketch": sketches(F.col("text"))})
    own = own.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    own = own.withColumn("edited_sketch", sketches(F.col("edited")))
    return own.select(id_col, F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                      fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
                      likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                      likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
