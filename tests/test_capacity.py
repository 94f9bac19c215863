"""Allocation rule: the worked examples of the planning rules, brute force, invariants."""

import datetime as dt
import json
import random

import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from castplan.operators import blocks, capacity
from castplan.schemas import CapacityLimits, resolve_max_jobs_per_day
from helpers import alloc_frame, by_day
from k1_bruteforce import brute_allocate

REF = dt.date(2026, 8, 10)


def run(spark, rows, max_jobs=10, ref=REF):
    df = alloc_frame(spark, rows)
    return capacity.mold_assignments(df, ref, CapacityLimits(max_jobs_per_day=max_jobs))


def test_line_molds_cap_thirty_per_day(spark):
    out = run(spark, [{"job": f"L{i:03d}", "molds": 6} for i in range(1, 7)])
    assert by_day(out) == {1: 30, 2: 6}


def test_combined_daily_limit_is_thirty_three(spark):
    rows = [{"job": f"L{i:03d}", "molds": 6} for i in range(1, 6)]
    rows.append({"job": "Z100", "cast": "F", "molds": 4})
    out = run(spark, rows)
    assert by_day(out)[1] == 33
    floor1 = out.where((F.col("schedule_day") == 1) & (F.col("casting_type") == "F"))
    assert floor1.agg(F.sum("molds_for_ext")).first()[0] == 3


def test_floor_first_does_not_block_line(spark):
    rows = [{"job": "A100", "cast": "F", "molds": 5}] + [{"job": f"L{i:03d}", "molds": 6} for i in range(1, 6)]
    out = run(spark, rows)
    assert by_day(out)[1] == 33


def test_urgent_window_pulls_forward(spark):
    rows = [{"job": "LONG", "molds": 1, "due": "2026-12-15"}, {"job": "SOON", "molds": 1, "due": "2026-09-10"}]
    # one job per day makes the order visible as days
    out = run(spark, rows, max_jobs=1, ref=dt.date(2026, 8, 1))
    got = {r["job_number"]: r["schedule_day"] for r in out.collect()}
    assert got == {"SOON": 1, "LONG": 2}


def test_per_job_cap_splits_over_days(spark):
    out = run(spark, [{"job": "L100", "molds": 14}])
    assert by_day(out) == {1: 6, 2: 6, 3: 2}


def test_floor_cap_three_per_day(spark):
    out = run(spark, [{"job": "F1", "cast": "F", "molds": 2}, {"job": "F2", "cast": "F", "molds": 2}])
    assert by_day(out) == {1: 3, 2: 1}


def test_max_ten_jobs_per_day(spark):
    out = run(spark, [{"job": f"J{i:04d}", "molds": 1} for i in range(1, 13)])
    jobs = {r["schedule_day"]: r["n"] for r in
            out.groupBy("schedule_day").agg(F.count_distinct("job_number").alias("n")).collect()}
    assert jobs == {1: 10, 2: 2} and out.count() == 12


def test_due_date_then_group_order(spark):
    rows = [{"job": "B2", "alloy": "B", "group": "GROUP-B", "due": "2026-08-22", "molds": 1},
            {"job": "A1", "due": "2026-08-25", "molds": 1},
            {"job": "A0", "due": "2026-08-20", "molds": 1}]
    out = run(spark, rows, max_jobs=1)
    got = [r["job_number"] for r in out.orderBy("schedule_day").collect()]
    assert got == ["A0", "B2", "A1"]


def test_chunk_weight_truncated(spark):
    out = run(spark, [{"job": "W1", "molds": 3, "weight": 10.7}])
    assert out.first()["total_weight_per_ext"] == 32


def test_pools_are_independent(spark):
    rows = [{"job": f"L{i}", "molds": 6, "pool": p} for p in (1, 2) for i in range(6)]
    out = run(spark, rows)
    per = {(r["pool"], r["schedule_day"]): r["m"] for r in
           out.groupBy("pool", "schedule_day").agg(F.sum("molds_for_ext").alias("m")).collect()}
    assert per == {(1, 1): 30, (1, 2): 6, (2, 1): 30, (2, 2): 6}


def test_max_jobs_setting_parse():
    assert resolve_max_jobs_per_day("abc") == 10
    assert resolve_max_jobs_per_day("0") == 1
    assert resolve_max_jobs_per_day(" 7 ") == 7


def stream_frame(items, shuffled=None):
    """Rows as ``lane_paced`` delivers them, for items (job, cast type, molds) in priority order."""
    lane, per_job, rows = [0, 0], {}, []
    for k, (job, cast, molds) in enumerate(items):
        floor = cast == "F"
        lane[floor] += 1
        per_job[job, floor] = per_job.get((job, floor), 0) + 1
        rows.append((k, k, 1, job, floor, molds, lane[floor], per_job[job, floor]))
    df = pd.DataFrame(rows, columns=["seq", "row_hash", "row_copy", "job_key", "is_floor", "molds", "lane_pos", "job_pos"])
    df = df.assign(line_n=lane[0], floor_n=lane[1], job_line_n=[per_job.get((j, False), 0) for j in df.job_key],
                   job_floor_n=[per_job.get((j, True), 0) for j in df.job_key])
    return df if shuffled is None else df.sample(frac=1, random_state=shuffled)


def stream(df, max_jobs=10, batch=50):
    got = []
    for b in capacity.allocate_stream((df.iloc[a:a + batch] for a in range(0, len(df), batch)),
                                      CapacityLimits(max_jobs_per_day=max_jobs), out_rows=3):
        got += list(zip(b.row_hash, b.schedule_day, b.molds_for_ext))
    return sorted(got)


def test_allocator_equals_brute_force_with_repeated_jobs():
    rnd = random.Random(7)
    for t in range(1500):
        n, nj = rnd.randint(0, 30), rnd.randint(1, 35)
        items = [(f"J{rnd.randint(1, nj)}", rnd.choice("FLL"), rnd.randint(1, 20)) for _ in range(n)]
        mj = rnd.choice([1, 2, 3, 10])
        # in priority order, and in any other order of arrival
        df = stream_frame(items, rnd.choice([None, t]))
        assert stream(df, mj, rnd.choice([1, 4, 50])) == sorted(brute_allocate(items, max_jobs=mj))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("FLLL"), st.integers(1, 25)), max_size=40),
       st.integers(1, 12))
def test_invariants(items, max_jobs):
    out = stream(stream_frame([(f"J{i}", c, m) for i, (c, m) in enumerate(items)]), max_jobs)
    # molds conserved
    assert sum(t for _, _, t in out) == sum(m for _, m in items)
    # daily caps respected
    for d in {d for _, d, _ in out}:
        own = [(p, t) for p, e, t in out if e == d]
        assert len({p for p, _ in own}) <= max_jobs
        assert sum(t for p, t in own if items[p][0] != "F") <= 30
        assert sum(t for p, t in own if items[p][0] == "F") <= 3
        assert all(t <= 6 for p, t in own if items[p][0] != "F")
    # order monotone within a lane: a row never starts before an earlier row of its lane
    first = {}
    for p, d, _ in out:
        first[p] = min(d, first.get(p, d))
    for lane in "FL":
        ps = sorted(p for p in first if (items[p][0] == "F") == (lane == "F"))
        assert all(first[a] <= first[b] for a, b in zip(ps, ps[1:]))


def test_floor_closed_form_equals_allocator(spark):
    rnd = random.Random(3)
    rows = [{"job": f"F{i:03d}", "cast": "F", "molds": rnd.randint(1, 9), "pool": i % 3,
             "due": f"2026-{rnd.randint(8, 12):02d}-{rnd.randint(1, 28):02d}"} for i in range(40)]
    df = alloc_frame(spark, rows)
    a = capacity.mold_assignments(df, REF).withColumn("pool_key", F.col("pool").cast("string"))
    b = capacity.floor_lane_closed_form(df, REF, CapacityLimits(), ("pool",))
    norm = lambda x: sorted(tuple(r) for r in x.select("pool_key", "job_number", "schedule_day", "molds_for_ext").collect())
    assert norm(a) == norm(b)


def test_capacity_check_finds_no_violation(spark):
    rows = [{"job": f"J{i}", "molds": (i * 7) % 15 + 1, "cast": "F" if i % 4 == 0 else "L"} for i in range(30)]
    df = alloc_frame(spark, rows)
    out = capacity.mold_assignments(df, REF)
    chk = capacity.capacity_check(out, df).first()
    assert chk["planned_molds"] == chk["assigned_molds"] and chk["violation_days"] == 0


def spark_equals_brute(spark, rows):
    """``allocate`` over pools against the literal rule, row by row."""
    df = capacity.with_row_id(alloc_frame(spark, rows))
    inp = capacity.allocation_input(df, REF).toPandas()
    keys = [k for k in capacity.SORT_KEYS]
    got = {}
    for r in capacity.allocate(df, REF).collect():
        got.setdefault((r.row_hash, r.row_copy), []).append((r.schedule_day, r.molds_for_ext))
    for _, part in inp.groupby("pool_key", dropna=False):
        part = part.sort_values(keys, na_position="last", kind="mergesort").reset_index(drop=True)
        want = {}
        for i, day, n in brute_allocate([(r.job_key, "F" if r.is_floor else "L", r.molds) for r in part.itertuples()]):
            want.setdefault((part.row_hash[i], part.row_copy[i]), []).append((day, n))
        for k, v in want.items():
            assert sorted(got.pop(k)) == sorted(v)
    assert not got


def test_spark_allocation_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [{"job": f"J{rnd.randint(1, 90):03d}", "molds": rnd.randint(1, 17), "cast": rnd.choice("FLLL"), "pool": i % 4,
             "due": f"2026-{rnd.randint(8, 12):02d}-{rnd.randint(1, 28):02d}"} for i in range(160)]
    spark_equals_brute(spark, rows + rows[:20])  # equal rows too


def test_repeated_jobs_keep_their_molds(spark):
    for ext in ("A", "B"), ("", ""):
        rows = [{"job": "J1", "molds": 4, "ext": e} for e in ext]
        df = alloc_frame(spark, rows)
        out = capacity.mold_assignments(df, REF)  # the rows share the 6-mold job cap
        assert by_day(out) == {1: 6, 2: 2} and out.count() == 3
        check = capacity.capacity_check(out, df).first()
        assert check["planned_molds"] == check["assigned_molds"] == 8


def in_blocks(items, max_jobs, days, overlap, monkeypatch):
    """The blocks of one pool, filled one after another as their tasks would, and the second pass."""
    monkeypatch.setattr(blocks, "DAYS", days)
    monkeypatch.setattr(blocks, "OVERLAP", overlap)
    limits = CapacityLimits(max_jobs_per_day=max_jobs)
    df = stream_frame(items)
    caps = np.where(df.is_floor, 3, 30)
    lane_end = df.groupby("is_floor").molds.cumsum()
    last = [{j: p for j, p, f in zip(df.job_key, df.lane_pos, df.is_floor) if f == floor} for floor in (False, True)]
    df = df.assign(lane_end=lane_end, job_line_last=[last[0].get(j, 0) for j in df.job_key], job_floor_last=[last[1].get(j, 0) for j in df.job_key])
    molds = [int(df.molds[df.is_floor == f].sum()) for f in (False, True)]
    n = max(-(-max(-(-molds[0] // 30), -(-molds[1] // 3)) // days), 1)
    to = np.minimum((lane_end - 1) // (caps * days), n - 1)
    since = np.minimum(np.maximum((lane_end - df.molds - caps * 2 * overlap) // (caps * days), 0), to)
    chunks, metas = [], {}
    for k in range(n):
        own = df[(since <= k) & (to >= k)]
        done, meta = blocks.run_block(list(blocks._Resumed.rows_of([own])), own.lane_end.tolist(), k, n, limits)
        chunks.append(done)
        metas[k] = json.loads(json.dumps(meta))
    got, taken = [], set()
    est = np.maximum((lane_end - df.molds) // caps, 0)
    rows = df.assign(est_day=est).sort_values(["est_day", "seq"], kind="mergesort")
    for what, *v in blocks.repair(metas, blocks._Resumed.rows_of([rows]), limits):
        if what == "take":
            taken.add(v[0])
            got += [(a, d, m) for a, _, d, m, _ in chunks[v[0]] if d >= v[1] and (v[2] is None or d < v[2])]
        else:
            got.append((v[0], v[2], v[3]))
    return sorted(got), n, taken


def test_blocks_equal_brute_force(monkeypatch):
    rnd = random.Random(11)
    cut = late = 0
    for t in range(700):
        n, nj = rnd.randint(1, 60), rnd.choice([3, 10, 200])
        big = rnd.choice([4, 17, 60])
        items = [(f"J{rnd.randint(1, nj)}", rnd.choice(rnd.choice(["FLL", "FLLLLLLL", "L", "F"])), rnd.randint(1, big)) for _ in range(n)]
        mj = rnd.choice([1, 2, 3, 10, 50])
        days = rnd.choice([3, 5, 9])
        got, blocks_n, taken = in_blocks(items, mj, days, rnd.choice([1, 2, 3]), monkeypatch)
        assert got == sorted(brute_allocate(items, max_jobs=mj)), t
        cut += blocks_n > 2
        late += blocks_n > 2 and max(taken) > 0
    assert cut > 200 and late > 60


def test_blocks_of_a_long_pool_are_taken_over(monkeypatch):
    """Where capacity binds on every day the guesses hold, and nothing is filled twice."""
    rnd = random.Random(12)
    items = [(f"J{i}", "F" if i % 10 == 0 else "L", rnd.randint(1, 17)) for i in range(3000)]
    got, n, taken = in_blocks(items, 50, 64, 24, monkeypatch)
    assert n > 12 and len(taken) == n and got == sorted(brute_allocate(items, max_jobs=50))
    got, n, taken = in_blocks(items, 10, 64, 24, monkeypatch)  # slots bind; the floor lane's tail is taken over
    assert got == sorted(brute_allocate(items, max_jobs=10)) and len(taken) > 2


def test_a_hot_pool_in_spark(spark, monkeypatch):
    monkeypatch.setattr(blocks, "DAYS", 12)
    monkeypatch.setattr(blocks, "OVERLAP", 4)
    rnd = random.Random(13)
    rows = [{"job": f"J{rnd.randint(1, 400):03d}", "molds": rnd.randint(1, 17), "cast": rnd.choice("FLLLLL"), "pool": 0 if i % 2 else i % 6,
             "due": f"2026-{rnd.randint(8, 12):02d}-{rnd.randint(1, 28):02d}"} for i in range(500)]
    spark_equals_brute(spark, rows)
    spark_equals_brute(spark, [{**r, "pool": None} for r in rows[:200]])


def test_pool_columns_with_separators_do_not_clash(spark):
    rows = [{"job": f"L{i}", "molds": 6, "pool": 1} for i in range(6)]
    df = alloc_frame(spark, rows).withColumn("a", F.when(F.col("job_number") < "L3", "x|y").otherwise("x")) \
        .withColumn("b", F.when(F.col("job_number") < "L3", "z").otherwise("y|z"))
    out = capacity.mold_assignments(df, REF, pool_cols=("a", "b"))
    assert by_day(out) == {1: 36}  # two pools of three rows each


def test_stream_memory_follows_lane_pacing(monkeypatch):
    """Rows held by the stream: in plain priority order a fast lane must read far ahead when
    the lanes progress at different rates; delivered by (estimated day, seq) — what
    ``lane_paced`` computes in Spark — the same pool is allocated identically holding few rows."""
    def run(df):
        held = []

        class Probe(capacity._Pool):
            def pull(self):
                ok = super().pull()
                held.append(len(self.items))
                return ok

        monkeypatch.setattr(capacity, "_Pool", Probe)
        got = stream(df, batch=4096)
        monkeypatch.undo()
        return max(held), got

    n = 20_000
    df = stream_frame([(f"J{k}", "F" if k % 500 == 0 else "L", (k * 7) % 13 + 1) for k in range(n)])
    held_plain, plain = run(df)
    lane = df.groupby("is_floor")
    cap = np.where(df.is_floor, 3, 30)
    est = np.maximum((lane.molds.cumsum() - df.molds) // cap, lane.cumcount() // 10)
    held_paced, paced = run(df.assign(est_day=est).sort_values(["est_day", "seq"], kind="mergesort"))
    assert plain == paced
    assert held_plain > 5_000 and held_paced < 200


def test_running_sums_are_exact_over_many_slices(spark):
    from pyspark.sql import functions as F
    from castplan.operators.prefix import running_sums
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"),
                                     (F.col("id") % 7).alias("v")).repartition(5)
    out = running_sums(df, ["g"], ["k"], {"cs": F.col("v"), "rn": F.lit(1)}, slices=16)
    got = {(r["g"], r["k"]): (r["cs"], r["rn"]) for r in out.collect()}
    for g in range(3):
        cs = rn = 0
        for k in range(g, 5000, 3):
            cs += k % 7
            rn += 1
            assert got[(g, k)] == (cs, rn)


def test_driver_schedule_equals_brute_force(spark):
    from conftest import SF_CHECK
    from castplan.plans.schedule import REFERENCE_DATE, ScheduleParams, build_schedule
    p = ScheduleParams(reference_date=REFERENCE_DATE)
    assert ScheduleParams().reference_date == dt.date.today() and p.start_date == REFERENCE_DATE + dt.timedelta(days=1)
    rows = build_schedule(spark, SF_CHECK, p).schedule_rows
    names = {"job": "job_number", "molds": "molds_for_ext", "cast": "casting_type", "pool": "pool", "due": "due_date",
             "alloy": "alloy", "group": "compatibility_group"}
    local = [{k: r[v] for k, v in names.items()} for r in rows.collect()]
    assert len(local) > 500
    got = capacity.mold_assignments(rows, p.reference_date, p.limits, p.pool_cols)
    per_pool = {}
    for r in local:
        per_pool.setdefault(r["pool"], []).append(r)
    cutoff = p.reference_date + dt.timedelta(days=56)
    want = []
    for pool, own in per_pool.items():
        own.sort(key=lambda r: (not (r["due"] and r["due"] <= cutoff), r["due"] is None, r["due"] or dt.date.max, r["group"], r["job"].strip().upper()))
        want += [(pool, own[i]["job"], d, n) for i, d, n in brute_allocate([(r["job"], "F" if (r["cast"] or "L").strip().upper() == "F" else "L", r["molds"]) for r in own])]
    assert sorted(want) == sorted(map(tuple, got.select("pool", "job_number", "schedule_day", "molds_for_ext").collect()))


def test_small_pools_are_filled_in_bundles_of_many_tasks(spark, monkeypatch):
    """Blocks of many pools are one frame; tasks follow the rows, not their few bytes."""
    monkeypatch.setattr(blocks, "BUNDLE_ROWS", 10)
    rows = spark.createDataFrame([(None if p == 3 else p, f"j{p}-{i}", None, "F" if i % 3 else "L", "a", 10 + i % 40) for p in range(12) for i in range(15)],
                                 "pool int, job_number string, due_date date, casting_type string, alloy string, molds_for_ext int")
    paced = capacity.lane_paced(capacity.allocation_input(rows, "2001-06-01"))
    out = blocks.fill(paced, CapacityLimits())
    assert out.rdd.getNumPartitions() >= 12  # 180 rows
    own = paced.withColumns({"block": F.lit(0), "blocks": F.lit(1)}).toPandas()
    alone = [blocks._block_fn(CapacityLimits())((k, 0, 1), part) for k, part in own.groupby(own.pool_key.fillna("none"))]
    expected = sorted(pd.concat(alone)[["row_hash", "row_copy", "schedule_day", "molds_for_ext", "seq"]].itertuples(index=False, name=None))
    assert sorted(tuple(r) for r in out.collect()) == expected and len(expected) >= 180
