"""A capacity pool filled in parallel: speculative blocks of days.

The rule of ``capacity.py`` needs a day's end to begin the next.  ``fill`` guesses where a pool
stands at the start of every ``DAYS``-th day, as if both lanes had used their full capacity on every day
before: each lane is done up to that many molds, and the row at the mark has the rest.  Every block
of days is filled from its guess by a task of its own, on the rows around its days only, and runs
``OVERLAP`` days into the next block.  Both blocks keep a digest of the pending rows of each day in the
overlap: from the first day on which they agree, the next block's chunks are those of the
rule itself, as a day depends on the pending rows alone.

Where no day agrees (the job slots, say, kept a lane under its capacity), the pool's later blocks were
guessed wrong.  A second pass takes up the last block that is right at its end and fills day
after day until it meets a day of a later block's overlap with the same pending rows; from there that block
and those that agree with it are taken over.  So a result never depends on the guesses, only the time
does: pools whose capacity binds on every day, and the long tail in which one lane is left, are filled
by all blocks at once; a pool whose slots bind again and again is filled mostly by the second pass.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castplan.operators.capacity import ROW_ID, _Pool, fill_day, filled_days
from castplan.schemas import CapacityLimits
from castplan.session import store

#: Days of a block, and days that two neighbours both fill.
DAYS, OVERLAP = 256, 32
#: More pending rows than this before a lane's last touched row: the day gets no digest.
MOST_PENDING = 4096
#: Rows that a task fills at a time: the blocks of many small pools.  A block isn't split.
BUNDLE_ROWS, MOST_TASKS = 4000, 2000

_SCHEMA = ("pool_key string, block int, blocks int, row_hash long, row_copy int, schedule_day int, molds_for_ext int, seq long, "
           "meta string, line_reach long, floor_reach long")
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


class OutOfRows(Exception):
    """A block's days need a row that it wasn't given."""


class _Resumed(_Pool):
    """A pool from the start of some day on.

    ``state``: per lane the last touched position (``reach``), the pending rows up to it, and the
    lanes' sizes.  Rows up to ``reach`` that arrive are done or among those; rows of a (job, lane) arrive in order.
    With ``partial`` the rows given are a part of those left.
    """

    COLUMNS = (*_Pool.COLUMNS, "job_line_last", "job_floor_last")

    def __init__(self, rows, state: dict, partial: bool = False):
        super().__init__(())
        self._rows, self.partial = iter(rows), partial
        self.start = list(state["reach"])
        self.lasts: dict = {}
        self.known: dict = {}
        for row in sorted(state["rows"]):
            self._put(tuple(row))
        self.frontier, self.reach, self.sizes = list(self.start), list(self.start), tuple(state["sizes"])

    def _put(self, row) -> None:
        self.lasts[row[3]] = row[12:]
        self.known[row[0]] = row
        self.add(row[:12], row[9])

    def pull(self) -> bool:
        for row in self._rows:
            if row[6] > self.start[int(row[4])]:
                self._put(row)
                return True
        if self.partial:
            raise OutOfRows
        return False

    def first_of(self, job, lane: int):
        while (job, lane) not in self.next_pos:
            if self.lasts[job][lane] <= self.start[lane] or not self.pull():
                return None
        return super().first_of(job, lane)

    def finish(self, seq: int) -> None:
        del self.known[seq]
        super().finish(seq)

    def state(self) -> dict:
        """What the days to come depend on, the same for every way that led to it."""
        low = [(*self.known[q][:5], i[3], *self.known[q][6:]) for q, i in self.items.items() if i[4] <= self.reach[i[2]]]
        return {"reach": list(self.reach), "rows": sorted(low), "sizes": list(self.sizes)}

    def digest(self) -> str | None:
        low = sorted((q, i[3]) for q, i in self.items.items() if i[4] <= self.reach[i[2]])
        return hashlib.blake2b(repr((self.reach, low)).encode(), digest_size=12).hexdigest() if len(low) <= MOST_PENDING else None

    def more(self) -> bool:
        """Whether any row is pending."""
        return bool(self.items) or any(self.frontier[k] < self.sizes[k] for k in (0, 1)) and self.pull()


def first_day(block: int) -> int:
    return block * DAYS + 1


def guess(rows: list, ends: list, block: int, limits: CapacityLimits) -> dict:
    """The state at the start of a block if both lanes were always full; ``rows`` are sorted by seq."""
    sizes = list(rows[0][7:9])
    reach, pending = list(sizes), []
    for lane, cap in ((0, limits.line_molds_per_day), (1, limits.floor_molds_per_day)):
        mark = cap * DAYS * block
        own = [(r, e) for r, e in zip(rows, ends, strict=True) if int(r[4]) == lane and e > mark]
        if own:
            row, end = own[0]
            begun = end - mark < row[5]
            reach[lane] = row[6] if begun else row[6] - 1
            if begun:
                pending.append((*row[:5], end - mark, *row[6:]))
    return {"reach": reach, "rows": pending, "sizes": sizes}


def run_block(rows: list, ends: list, block: int, blocks: int, limits: CapacityLimits, until: int | None = None):
    """``(chunks, meta)`` of one block, filled from its guess."""
    state = guess(rows, ends, block, limits)
    last = block == blocks - 1
    pool = _Resumed(rows, state, partial=not last)
    begin, stop = first_day(block), first_day(block + 1) + OVERLAP
    chunks, own, after, end = [], {}, {}, None
    day = begin
    try:
        while pool.more() if last else True:
            if day == (until or first_day(block + 1)) and not last:
                end = (day, pool.state())
            if day == until or not last and day == stop:
                break
            if begin <= day < begin + OVERLAP and block:
                own[day] = pool.digest()
            if not last and day >= first_day(block + 1):
                after[day] = pool.digest()
            chunks += fill_day(pool, limits, day)
            day += 1
    except OutOfRows:
        if end is None:  # fill again up to the day that lacks rows, whose state is then the block's end
            return run_block(rows, ends, block, blocks, limits, day)
        chunks = [c for c in chunks if c[2] < day]
    return chunks, {"own": own, "after": after, "end": end}


def filled_block(pool_key, block: int, blocks: int, rows: list, ends: list, limits: CapacityLimits) -> list:
    """The result rows of one block of one pool, whose rows are sorted by seq."""
    if blocks == 1:
        pool = _Pool(())
        pool._rows = (row[:len(_Pool.COLUMNS)] for row in rows)
        chunks, last = [c for day in filled_days(pool, limits) for c in day], []
    else:
        chunks, meta = run_block(rows, ends, block, blocks, limits)
        reach = meta["end"][1]["reach"] if meta["end"] else [None, None]
        last = [(pool_key, block, blocks, None, None, None, None, None, json.dumps(meta), *reach)]
    return [(pool_key, block, blocks, *c, None, None, None) for c in chunks] + last


def _block_fn(limits: CapacityLimits):
    """One block of one pool."""
    def fill_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pool_key, block, blocks = key
        pdf = pdf.sort_values("seq")
        out = filled_block(None if pd.isna(pool_key) else pool_key, int(block), int(blocks), list(_Resumed.rows_of([pdf])), pdf["lane_end"].tolist(), limits)
        return pd.DataFrame(out, columns=_COLUMNS, dtype=object)  # no integer may become a double
    return fill_block


def _bundle_fn(limits: CapacityLimits):
    """The blocks of many pools: a frame for each of them would cost more than its days."""
    def fill_bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks: dict = {}
        keys = zip(pdf["pool_key"].tolist(), pdf["block"].tolist(), pdf["blocks"].tolist(), strict=True)
        for (pool_key, *block), row, end in zip(keys, _Resumed.rows_of([pdf]), pdf["lane_end"].tolist(), strict=True):
            blocks.setdefault((None if pd.isna(pool_key) else pool_key, *block), []).append((row, end))
        out: list = []
        for key, own in blocks.items():
            own.sort(key=lambda x: x[0][0])
            out += filled_block(*key, [row for row, _ in own], [end for _, end in own], limits)
        return pd.DataFrame(out, columns=_COLUMNS, dtype=object)  # no integer may become a double
    return fill_bundle


def agreed(block: dict, following: dict, since: int) -> int | None:
    """The first day from ``since`` on that both have filled up to with equal pending rows."""
    days = sorted(int(d) for d, digest in following["own"].items() if digest and block["after"].get(d) == digest)
    return next((d for d in days if d >= since), None)


def repair(metas: dict, rows, limits: CapacityLimits):
    """Yields ``("take", block, from day, to day)`` for stretches of blocks that are right, and the chunks
    ``("chunk", ...)`` of the days between them."""
    blocks = len(metas)
    block, since = 0, 1
    left: list = []
    while True:
        while block + 1 < blocks and (day := agreed(metas[block], metas[block + 1], since)) is not None:
            yield "take", block, since, day
            block, since = block + 1, day
        if block + 1 == blocks:
            yield "take", block, since, None
            return
        day, state = metas[block]["end"]
        yield "take", block, since, day
        pool = _Resumed(itertools.chain(left, rows), state)
        while True:
            later = (day - 1) // DAYS
            if block < later < blocks and str(day) in metas[later]["own"] and pool.digest() == metas[later]["own"][str(day)] is not None:
                block, since = later, day
                left = [pool.known[q] for q in sorted(pool.known) if pool.items[q][4] > pool.reach[pool.items[q][2]]]
                break
            if not pool.more():
                return
            for chunk in fill_day(pool, limits, day):
                yield "chunk", *chunk
            day += 1


_REPAIR = "pool_key string, block int, since int, until int, row_hash long, row_copy int, schedule_day int, molds_for_ext int, seq long"


def _repair_stream(limits: CapacityLimits):
    names = [c.split()[0] for c in _REPAIR.split(", ")]

    def fill_gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool_key, metas, first = None, {}, []
        batches = iter(batches)
        for pdf in batches:  # the blocks' records come first
            head = pdf[pdf["meta"].notna()]
            for pool_key, block, meta in zip(head["pool_key"], head["block"], head["meta"], strict=True):
                pool_key = None if pd.isna(pool_key) else pool_key
                metas[int(block)] = json.loads(meta)
            if len(head) < len(pdf):
                first = [pdf[pdf["meta"].isna()]]
                break

        def rows():
            for pdf in itertools.chain(first, batches):
                yield from _Resumed.rows_of([pdf])

        out: list = []
        for what, *values in repair(metas, rows(), limits):
            out.append((pool_key, *values, None, None, None, None, None) if what == "take" else (pool_key, None, None, None, *values))
            if len(out) >= 8192:
                yield pd.DataFrame(out, columns=names, dtype=object)  # no integer may become a double
                out.clear()
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)  # no integer may become a double
    return fill_gaps


def block_range(limits: CapacityLimits):
    """``(first, last)`` block that needs a row, by its place in its lane if that were always full."""
    per_day = F.when(F.col("is_floor"), F.lit(limits.floor_molds_per_day)).otherwise(F.lit(limits.line_molds_per_day))
    size = (per_day * DAYS).cast("long")
    early = F.col("lane_end") - F.col("molds") - per_day * (2 * OVERLAP)
    first = F.greatest(F.floor(early / size), F.lit(0))
    return first.cast("int"), F.floor((F.col("lane_end") - 1) / size).cast("int")


def fill(paced: DataFrame, limits: CapacityLimits) -> DataFrame:
    """Chunks ``row_hash, row_copy, schedule_day, molds_for_ext, seq`` of the rows of ``capacity.lane_paced``."""
    days = F.greatest(F.ceil(F.col("line_molds") / limits.line_molds_per_day), F.ceil(F.col("floor_molds") / limits.floor_molds_per_day))
    paced = paced.withColumn("blocks", F.ceil(days / DAYS).cast("int"))
    most, n = paced.agg(F.max("blocks"), F.count(F.lit(1))).first()
    most = most or 0
    if most > 1:
        paced = store(paced, "paced")
    first, last = block_range(limits)
    last = F.least(last, F.col("blocks") - 1)
    dealt = paced.withColumn("block", F.explode(F.sequence(F.least(first, last), last)))
    # as many tasks as the rows ask for: by their bytes, which are few, adaptive execution would leave a handful
    bundles = max(1, -(-n // BUNDLE_ROWS))
    bundle = F.pmod(F.xxhash64("pool_key", "block"), F.lit(bundles))
    filled = (dealt.withColumn("bundle", bundle).repartition(min(bundles, MOST_TASKS), "bundle").groupBy("bundle").applyInPandas(_bundle_fn(limits), _SCHEMA))
    chunk = [*ROW_ID, "schedule_day", "molds_for_ext", "seq"]
    if most <= 1:
        return filled.select(*chunk)
    filled = store(filled, "blocks")
    metas = filled.where("meta IS NOT NULL")
    # the block before the first disagreement of each pool; pools without one need no rows
    own, after = (metas.select("pool_key", (F.col("block") + F.lit(k)).alias("block"), F.explode(
        F.from_json(F.get_json_object("meta", f"$.{part}"), "map<string,string>")).alias("day", "digest")) for part, k in (("own", 0), ("after", 1)))
    same = own.intersect(after).where("digest IS NOT NULL").select("pool_key", "block").distinct()
    broken = (metas.select("pool_key", "block").where("block > 0").exceptAll(same).groupBy("pool_key").agg((F.min("block") - 1).alias("block")))
    start = (metas.join(broken.withColumnsRenamed({"pool_key": "_pool", "block": "_block"}), F.col("pool_key").eqNullSafe(F.col("_pool")) & (F.col("block") == F.col("_block")), "left_semi")
             .select(F.col("pool_key").alias("_pool"), "line_reach", "floor_reach"))
    reach = F.when(F.col("is_floor"), F.col("floor_reach")).otherwise(F.col("line_reach"))
    rows = (paced.where("blocks > 1").join(start, F.col("pool_key").eqNullSafe(F.col("_pool"))).where(F.col("lane_pos") > reach)
            .select("pool_key", "est_day", *_Resumed.COLUMNS))
    # no nulls in the numbers: pandas would read them as doubles
    blank = [F.lit("" if t == "string" else False if t == "boolean" else 0).cast(t).alias(c) for c, t in rows.select(*_Resumed.COLUMNS).dtypes]
    stream = (metas.select("pool_key", F.lit(-1).cast("long").alias("est_day"), "block", "meta", *blank)
              .unionByName(rows.withColumns({"block": F.lit(-1), "meta": F.lit(None).cast("string")}))
              .repartition("pool_key").sortWithinPartitions(F.col("pool_key").asc(), "est_day", "block", "seq"))
    mended = store(stream.groupBy("pool_key").applyInPandas(_repair_stream(limits), _REPAIR), "mended")
    taken = mended.where("block IS NOT NULL").select(F.col("pool_key").alias("_pool"), F.col("block").alias("_block"), "since", "until")
    kept = (filled.where("meta IS NULL AND blocks > 1").join(taken, F.col("pool_key").eqNullSafe(F.col("_pool")) & (F.col("block") == F.col("_block")))
            .where(F.col("schedule_day").between(F.col("since"), F.coalesce(F.col("until") - 1, F.col("schedule_day")))))
    return (filled.where("blocks = 1").select(*chunk).unionByName(kept.select(*chunk))
            .unionByName(mended.where("block IS NULL").select(*chunk)))
