"""Capacity-limited mold allocation.

Rule (per capacity pool), day = 1, 2, ...: scan pending rows in priority order — due within
the urgent window first, then due date (missing last), compatibility group, job number —
and give each row ``min(remaining, capacity)`` molds where

* a row is skipped when its job would be one more distinct job than ``max_jobs_per_day``;
* floor rows (casting type ``F``) share ``floor_molds_per_day``;
* all other rows are line work: ``min(line_molds_per_job_per_day - job's line molds today,
  line_molds_per_day - line molds today)``.

Rows may split over days; rows of one job share its job slot and per-job cap.

The rule is sequential inside a pool, so Spark parallelises across pools and, inside a long pool,
over speculative blocks of days (``blocks.py``): the narrow allocation input (row id, job, lane,
molds and positions) is grouped by pool and block and filled there (``applyInPandas``).  Wide rows
never cross the Arrow boundary; chunks join back on the row id.  ``floor_lane_closed_form`` is a
pure-SQL equivalent for floor-only pools.
"""

from __future__ import annotations

import datetime as _dt
import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castplan.functions.clean import norm_key_ws
from castplan.functions.dates import as_date_lit
from castplan.operators.prefix import running_sum, running_sums
from castplan.schemas import FLOOR_CAST_TYPE, URGENT_WINDOW_WEEKS, CapacityLimits
from castplan.session import store

ROW_ID = ["row_hash", "row_copy"]


def with_row_id(rows: DataFrame) -> DataFrame:
    """``rows`` with a real row id in two columns.  Rows that have one keep it; the number of
    ``ordinal.py`` is one by itself; else it is a hash of every column, and a number among the rows of equal hash,
    by all columns, so that every evaluation gives the same."""
    if set(ROW_ID) <= set(rows.columns):
        return rows
    if "row_seq" in rows.columns:
        return rows.withColumns({"row_hash": F.col("row_seq"), "row_copy": F.lit(1)})
    hashed = rows.withColumn("row_hash", F.xxhash64(F.to_json(F.struct(*rows.columns))))
    return hashed.withColumn("row_copy", F.row_number().over(Window.partitionBy("row_hash").orderBy(*rows.columns)))


class _Pool:
    """Pending rows of one pool, read lazily from Arrow batches in any order.

    Of every (job, lane) only the first pending row can take molds at any moment, so each lane is
    a heap of those; rows that finish out of turn are dropped when they reach its top.
    ``lane_pos``/``job_pos`` number the rows of a lane and of a (job, lane) from 1; they tell whether
    an earlier row is still unread.
    """

    COLUMNS = ("seq", "row_hash", "row_copy", "job_key", "is_floor", "molds", "lane_pos", "line_n", "floor_n",
               "job_pos", "job_line_n", "job_floor_n")

    def __init__(self, batches):
        self._rows = self.rows_of(batches)
        self.items: dict = {}  # seq -> [row id, job, lane, remaining, lane_pos, job_pos]
        self.heaps = ([], [])  # line, floor
        self.frontier, self._ahead = [0, 0], (set(), set())
        self.reach = [0, 0]  # greatest lane_pos that ever took molds
        self.sizes = None  # rows per lane
        self.waiting: dict = {}  # (job, lane) -> {job_pos: seq}
        self.next_pos: dict = {}  # (job, lane) -> first pending job_pos
        self.job_sizes: dict = {}  # job -> rows per lane

    @classmethod
    def rows_of(cls, batches):
        for b in batches:
            yield from zip(*[b[c].tolist() for c in cls.COLUMNS])

    def pull(self) -> bool:
        row = next(self._rows, None)
        if row is None:
            return False
        self.add(row, 1)
        return True

    def add(self, row, first_pos: int) -> None:
        seq, a, b, job, floor, molds, lane_pos, line_n, floor_n, job_pos, job_line_n, job_floor_n = row
        lane = int(floor)
        self.sizes = (line_n, floor_n)
        self._ahead[lane].add(lane_pos)
        while self.frontier[lane] + 1 in self._ahead[lane]:
            self.frontier[lane] += 1
            self._ahead[lane].remove(self.frontier[lane])
        self.job_sizes[job] = (job_line_n, job_floor_n)
        self.items[seq] = [(a, b), job, lane, int(molds), lane_pos, job_pos]
        key = (job, lane)
        self.waiting.setdefault(key, {})[job_pos] = seq
        if job_pos == self.next_pos.setdefault(key, first_pos):
            heapq.heappush(self.heaps[lane], seq)

    def head(self, lane: int):
        """Priority position of the lane's next row, or None if the lane is empty; reads on
        until no unread row can come before it."""
        heap = self.heaps[lane]
        while True:
            while heap and heap[0] not in self.items:
                heapq.heappop(heap)
            if heap and self.items[heap[0]][4] <= self.frontier[lane]:
                return heap[0]
            if self.sizes is not None and self.frontier[lane] >= self.sizes[lane]:
                return heap[0] if heap else None
            if not self.pull():
                return heap[0] if heap else None

    def first_of(self, job, lane: int):
        """Priority position of the first pending row of (job, lane), reading on to find it."""
        while self.next_pos.get((job, lane), 1) <= self.job_sizes[job][lane]:
            seq = self.waiting.get((job, lane), {}).get(self.next_pos.get((job, lane), 1))
            if seq is not None:
                return seq
            if not self.pull():
                return None
        return None

    def finish(self, seq: int) -> None:
        """Drop a row that has all its molds; its job's next row takes its place in the lane."""
        _, job, lane, _, _, job_pos = self.items.pop(seq)
        key = (job, lane)
        own = self.waiting[key]
        del own[job_pos]
        self.next_pos[key] = job_pos + 1
        if job_pos + 1 in own:
            heapq.heappush(self.heaps[lane], own[job_pos + 1])
        elif not own and job_pos >= self.job_sizes[job][lane]:
            del self.waiting[key]


def fill_day(pool: _Pool, limits: CapacityLimits, day: int) -> list:
    """Give the day's molds; returns its chunks ``(row_hash, row_copy, day, molds, seq)``."""
    caps = (limits.line_molds_per_day, limits.floor_molds_per_day)
    job_cap, max_jobs = limits.line_molds_per_job_per_day, max(int(limits.max_jobs_per_day), 1)
    out: list = []
    jobs: dict = {}  # job -> line molds today
    used = [0, 0]

    def room(job, lane):
        left = caps[lane] - used[lane]
        return left if lane else min(left, job_cap - jobs.get(job, 0))

    def take(seq):  # whether the row is still pending
        item = pool.items[seq]
        row, job, lane = item[0], item[1], item[2]
        n = min(item[3], room(job, lane))
        if n > 0:
            item[3] -= n
            used[lane] += n
            jobs[job] = jobs.get(job, 0) + (0 if lane else n)
            pool.reach[lane] = max(pool.reach[lane], item[4])
            out.append((*row, day, n, seq))
        if item[3] == 0:
            pool.finish(seq)
            return False
        return True

    resting: list = []  # taken from its heap today and still pending
    while len(jobs) < max_jobs:
        heads = [h for h in (pool.head(lane) for lane in (0, 1) if used[lane] < caps[lane]) if h is not None]
        if not heads:
            break
        seq = min(heads)
        heapq.heappop(pool.heaps[pool.items[seq][2]])
        if take(seq):
            resting.append(seq)
    if len(jobs) >= max_jobs:
        # job slots are used: only further rows of today's jobs may take molds, in priority order
        done = set(resting)
        while True:
            open_rows = []
            for job in jobs:
                for lane in (0, 1):
                    if room(job, lane) > 0:
                        seq = pool.first_of(job, lane)
                        if seq is not None and seq not in done:
                            open_rows.append(seq)
            if not open_rows:
                break
            seq = min(open_rows)
            if take(seq):  # it stays in its heap
                done.add(seq)
    for seq in resting:
        heapq.heappush(pool.heaps[pool.items[seq][2]], seq)
    return out


def chunk_frame(chunks: list) -> pd.DataFrame:
    return pd.DataFrame(chunks, columns=[*ROW_ID, "schedule_day", "molds_for_ext", "seq"]).astype(
        {"row_hash": "int64", "row_copy": "int32", "schedule_day": "int32", "molds_for_ext": "int32", "seq": "int64"})


def filled_days(pool: _Pool, limits: CapacityLimits):
    """The chunks of every day from the first on, until no row is pending."""
    day = 0
    while pool.items or pool.pull():
        day += 1
        yield fill_day(pool, limits, day)


def allocate_stream(batches, limits: CapacityLimits = CapacityLimits(), out_rows: int = 8192):
    """The allocation rule for one pool, as a stream; yields DataFrames of chunks.

    One path for any rows: jobs may have several rows, in one lane or both.  Rows may arrive in
    any order; the order decides only how many are held (see ``lane_paced``).  A chunk costs the
    logarithm of the rows held and, once the job slots are used, a look at the day's jobs.
    """
    out: list = []
    for chunks in filled_days(_Pool(batches), limits):
        out += chunks
        if len(out) >= out_rows:
            yield chunk_frame(out)
            out.clear()
    if out:
        yield chunk_frame(out)


def _pool_key(pool_cols):
    """One text per pool; several columns are told apart as JSON."""
    if not pool_cols:
        return F.lit("")
    return F.col(pool_cols[0]).cast("string") if len(pool_cols) == 1 else F.to_json(F.struct(*pool_cols))


def allocation_input(rows: DataFrame, reference_date, pool_cols=("pool",)) -> DataFrame:
    """Narrow per-row allocation input: row id, pool key, job key, lane, molds, sort keys."""
    rows = with_row_id(rows)
    ref = as_date_lit(reference_date)
    cutoff = F.date_add(ref, 7 * URGENT_WINDOW_WEEKS)
    due = F.col("due_date").cast("string").try_cast("date")
    group = (F.col("compatibility_group") if "compatibility_group" in rows.columns
             else F.coalesce(F.col("alloy"), F.lit("")))
    ct = F.upper(F.trim(F.coalesce(F.col("casting_type").cast("string"), F.lit("L"))))
    ext = F.col("ext").cast("string") if "ext" in rows.columns else F.lit("")
    return rows.select(
        *ROW_ID, _pool_key(pool_cols).alias("pool_key"), norm_key_ws("job_number").alias("job_key"),
        (ct == FLOOR_CAST_TYPE).alias("is_floor"),
        F.coalesce(F.col("molds_for_ext").cast("string").try_cast("double").cast("int"), F.lit(0)).alias("molds"),
        F.when(due.isNotNull() & (due <= cutoff), 0).otherwise(1).alias("urgent"),
        F.datediff(due, F.lit(_dt.date(1970, 1, 1))).alias("due_ord"),
        group.cast("string").alias("group_key"), F.col("job_number").cast("string").alias("job_text"), ext.alias("ext_key"),
    ).where((F.col("job_key") != "") & (F.col("molds") > 0))


#: Priority order inside a pool: the rule's keys, then text, molds and the row id as tie-breaks.
SORT_KEYS = ("urgent", "due_ord", "group_key", "job_key", "job_text", "ext_key", "molds", *ROW_ID)


def allocate(rows: DataFrame, reference_date, limits: CapacityLimits = CapacityLimits(), pool_cols=("pool",)) -> DataFrame:
    """Allocation chunks: ``row_hash, row_copy, schedule_day, molds_for_ext, seq`` (one per row-day; ``seq`` is
    the row's priority position in its pool).

    Pools run in parallel, and long pools in blocks of days (``blocks.fill``).  There is one path, for
    unique and for repeated jobs.
    """
    from castplan.operators import blocks  # it fills days by this module's rule

    return blocks.fill(lane_paced(allocation_input(rows, reference_date, pool_cols), limits), limits)


def lane_paced(inp: DataFrame, limits: CapacityLimits = CapacityLimits()) -> DataFrame:
    """Add ``seq`` (priority position in the pool), the positions and row counts that the
    allocator checks reading by (``lane_pos``, ``job_pos``, ...), and ``est_day``, a lower bound of
    the day a row can start: its lane's molds before it over the lane's daily molds or its lane's
    rows before it over the daily job slots; a further row of a job may also follow the job's first
    row, at the pace of the job's daily cap.  Delivering rows by ``(est_day, seq)`` paces the two
    lanes against each other, so rows arrive about when they are needed instead of after the other
    lane's backlog."""
    order = [F.col(c).asc_nulls_last() for c in SORT_KEYS]
    fl = F.col("is_floor")
    slots = F.lit(max(int(limits.max_jobs_per_day), 1))
    d = running_sums(inp, ["pool_key"], order, {
        "seq": F.lit(1),
        "_floor_molds": F.when(fl, F.col("molds")).otherwise(0),
        "_line_molds": F.when(fl, 0).otherwise(F.col("molds")),
        "_floor_rows": F.when(fl, 1).otherwise(0),
        "_line_rows": F.when(fl, 0).otherwise(1)})
    before = F.when(fl, F.col("_floor_molds")).otherwise(F.col("_line_molds")) - F.col("molds")
    cap = F.when(fl, F.lit(limits.floor_molds_per_day)).otherwise(F.lit(limits.line_molds_per_day))
    d = d.withColumns({"lane_pos": F.when(fl, F.col("_floor_rows")).otherwise(F.col("_line_rows")),
                       "lane_end": F.when(fl, F.col("_floor_molds")).otherwise(F.col("_line_molds"))})
    # several rows of a lane's earlier days may belong to one job, which takes one slot
    lane_est = F.floor(before / cap)
    job = Window.partitionBy("pool_key", "job_key")
    lane = Window.partitionBy("pool_key", "job_key", "is_floor").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_est", lane_est)
    d = d.withColumns({"job_line_n": F.count_if(~fl).over(job), "job_floor_n": F.count_if(fl).over(job), "_job_est": F.min("_est").over(job),
                       "job_line_last": F.coalesce(F.max(F.when(~fl, F.col("lane_pos"))).over(job), F.lit(0)),
                       "job_floor_last": F.coalesce(F.max(F.when(fl, F.col("lane_pos"))).over(job), F.lit(0)),
                       "job_pos": F.count(F.lit(1)).over(lane), "_job_before": F.sum("molds").over(lane) - F.col("molds")})
    job_cap = F.when(fl, F.lit(limits.floor_molds_per_day)).otherwise(F.lit(limits.line_molds_per_job_per_day))
    jobs_only = F.floor((F.col("lane_pos") - 1) / slots)
    alone = F.col("job_line_n") + F.col("job_floor_n") == 1
    est = F.when(alone, F.greatest("_est", jobs_only)).otherwise(
        F.least(F.col("_est"), F.col("_job_est") + F.floor(F.col("_job_before") / job_cap)))
    # rows per lane: one row per pool, joined with a null-safe key
    sizes = inp.groupBy(F.col("pool_key").alias("_pool")).agg(
        F.count_if(~fl).alias("line_n"), F.count_if(fl).alias("floor_n"),
        F.sum(F.when(fl, 0).otherwise(F.col("molds"))).alias("line_molds"), F.sum(F.when(fl, F.col("molds")).otherwise(0)).alias("floor_molds"))
    d = d.withColumn("est_day", est.cast("long")).join(sizes, F.col("pool_key").eqNullSafe(F.col("_pool")), "inner")
    return d.select("pool_key", "est_day", "seq", *ROW_ID, "job_key", "is_floor", "molds", "lane_pos", "line_n", "floor_n",
                    "job_pos", "job_line_n", "job_floor_n", "job_line_last", "job_floor_last", "lane_end", "line_molds", "floor_molds")


def mold_assignments(rows: DataFrame, reference_date, limits: CapacityLimits = CapacityLimits(), pool_cols=("pool",)) -> DataFrame:
    """Schedule rows expanded to day chunks: every input column plus ``schedule_day`` and the
    chunk's ``molds_for_ext`` / ``total_weight_per_ext`` (truncated to whole pounds), the row's
    ``priority_seq`` in its pool (chunks follow each other by day, then by it), and the pour defaults ``pour_schedule_day = schedule_day``, ``heat_number = global_heat = 1``.
    """
    if "row_seq" not in rows.columns and not set(ROW_ID) <= set(rows.columns):
        # the id is a hash and a sort of whole rows, and they are read three times from here
        rows = store(with_row_id(rows), "row-ids")
    rows = with_row_id(rows)
    chunks = allocate(rows, reference_date, limits, pool_cols).withColumnRenamed("seq", "priority_seq")
    wide = rows.withColumnRenamed("molds_for_ext", "planned_molds_for_ext").drop("total_weight_per_ext", "priority_seq")
    w = F.greatest(F.coalesce(F.col("pour_weight").cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0)) \
        if dict(rows.dtypes)["pour_weight"] == "string" else F.greatest(F.coalesce(F.col("pour_weight"), F.lit(0)), F.lit(0))
    return (chunks.join(wide, ROW_ID, "inner").withColumns({
        "total_weight_per_ext": F.floor(w * F.col("molds_for_ext")).cast("long"),
        "pour_schedule_day": F.col("schedule_day"),
        "heat_number": F.lit(1),
        "global_heat_number": F.lit(1),
    }).drop(*ROW_ID))


def floor_lane_closed_form(rows: DataFrame, reference_date,
                           limits: CapacityLimits = CapacityLimits(),
                           pool_cols=("pool",)) -> DataFrame:
    """Floor-only allocation without Python: running molds in priority order per pool, then
    each row's mold interval ``[before, before + molds)`` is cut at multiples of the floor
    limit.  Equals ``allocate`` for floor-only pools when ``max_jobs_per_day`` is at least
    the floor limit.  Output: ``pool_key, job_number, schedule_day, molds_for_ext``.
    """
    inp = allocation_input(rows, reference_date, pool_cols).where(F.col("is_floor"))
    cap = limits.floor_molds_per_day
    order = [F.col(c).asc_nulls_last() for c in SORT_KEYS]
    c = running_sum(inp, ["pool_key"], order, "molds", "_end")
    c = c.withColumn("_start", F.col("_end") - F.col("molds"))
    d = c.withColumn("schedule_day", F.explode(F.sequence(
        (F.floor(F.col("_start") / cap) + 1).cast("int"), (F.floor((F.col("_end") - 1) / cap) + 1).cast("int"))))
    lo = F.greatest(F.col("_start"), (F.col("schedule_day") - 1) * cap)
    hi = F.least(F.col("_end"), F.col("schedule_day") * cap)
    return d.select("pool_key", F.col("job_text").alias("job_number"), "schedule_day",
                    (hi - lo).cast("int").alias("molds_for_ext"))


def capacity_check(assignments: DataFrame, rows: DataFrame, limits: CapacityLimits = CapacityLimits(),
                   pool_cols=("pool",)) -> DataFrame:
    """Invariants per pool: molds conserved and no day over any cap.

    Output: ``pool, planned_molds, assigned_molds, days, violation_days``.
    """
    ct = F.upper(F.trim(F.coalesce(F.col("casting_type"), F.lit("L"))))
    per_job = (assignments.groupBy(*pool_cols, "schedule_day", "job_number")
               .agg(F.sum(F.when(ct != FLOOR_CAST_TYPE, F.col("molds_for_ext")).otherwise(0)).alias("line_j"),
                    F.sum(F.when(ct == FLOOR_CAST_TYPE, F.col("molds_for_ext")).otherwise(0)).alias("floor_j"),
                    F.sum("molds_for_ext").alias("m_j")))
    per_day = (per_job.groupBy(*pool_cols, "schedule_day")
               .agg(F.sum("line_j").alias("line"), F.sum("floor_j").alias("floor"),
                    F.count(F.lit(1)).alias("jobs"), F.max("line_j").alias("max_line_job"),
                    F.sum("m_j").alias("molds")))
    bad = ((F.col("line") > limits.line_molds_per_day) | (F.col("floor") > limits.floor_molds_per_day)
           | (F.col("jobs") > limits.max_jobs_per_day)
           | (F.col("max_line_job") > limits.line_molds_per_job_per_day))
    assigned = per_day.groupBy(*pool_cols).agg(F.sum("molds").alias("assigned_molds"),
                                               F.count(F.lit(1)).alias("days"),
                                               F.count_if(bad).alias("violation_days"))
    planned = rows.groupBy(*pool_cols).agg(F.sum("molds_for_ext").alias("planned_molds"))
    return planned.join(assigned, list(pool_cols), "full_outer").select(
        *pool_cols, F.coalesce("planned_molds", F.lit(0)).alias("planned_molds"),
        F.coalesce("assigned_molds", F.lit(0)).alias("assigned_molds"),
        F.coalesce("days", F.lit(0)).alias("days"),
        F.coalesce("violation_days", F.lit(0)).alias("violation_days"))


def seed_when_empty(assignments: DataFrame, rows: DataFrame) -> DataFrame:
    """When allocation produced nothing, seed a melt schedule with every row on pour day 1
    in heat 1 (one cheap emptiness probe; otherwise the assignments pass through)."""
    if not assignments.isEmpty():
        return assignments
    return rows.withColumns({"schedule_day": F.lit(None).cast("int"), "pour_schedule_day": F.lit(1),
                             "heat_number": F.lit(1), "global_heat_number": F.lit(1)})
