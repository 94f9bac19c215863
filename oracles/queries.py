"""DuckDB oracle SQL, one string per registered query.

Each string starts with the ERP view CTEs (``erp_views``) and then restates the operator in
plain SQL, written independently of the Spark code.  Numeric outputs are cast to DOUBLE or
BIGINT and dates to DATE so both sides hash the same values.
"""

from oracles.erp_views import ERP_CTES, ORDER_SNAPSHOT, decode_date, nb, to_dec6

REFERENCE_DATE = "DATE '2001-06-01'"
CALENDAR_START = "DATE '2001-06-02'"

MAIN_JOBS = f"""main_jobs AS (
  SELECT upper(trim(jm.job_number)) AS job_key,
         CAST(try_strptime(jm.due_date_text, '%Y-%m-%d') AS DATE) AS due,
         {nb('jm.customer_name')} AS customer_name, {nb('jm.product_code')} AS part,
         {nb('jm.job_type')} AS job_type, {nb('ic.base_material')} AS alloy,
         {nb('jm.casting_type')} AS casting_type, {nb('jm.heat_number')} AS main_heat,
         CASE WHEN {nb('jm.job_on_hold')} = 'þ' THEN 'YES' ELSE 'NO' END AS on_hold,
         COALESCE(jm.quantity_required, 0) AS qty_castings,
         {to_dec6('jm.tool_impressions')} AS castings_per_mold,
         COALESCE(jm.molds_required, 0) AS qty_molds,
         {to_dec6('jm.cores_text')} AS cores,
         {to_dec6('jm.pour_weight_text')} AS pour_weight,
         COALESCE(jm.pour_quantity, 0) AS total_pour,
         COALESCE(jm.contract_revised_amount, jm.contract_original_amount, 0) AS total_value,
         COALESCE(jm.quantity_produced, 0) AS castings_produced,
         COALESCE(jm.molds_produced, 0) AS molds_completed,
         jm.pool AS pool
  FROM job_master jm LEFT JOIN ic_master ic ON ic.product_code = jm.product_code
  WHERE {nb('jm.job_number')} IS NOT NULL AND jm.job_status_flag = 'I')"""

ORDERS_AGG = f"""orders_agg AS (
  SELECT upper(trim(COALESCE({nb('d.job_number')}, {nb('h.job_number')}))) AS job_key,
         max({nb('d.product_number')}) AS open_part,
         max({nb('d.job_type')}) AS open_job_type,
         max(COALESCE({decode_date('d.required_date')}, {decode_date('h.required_date')})) AS open_due,
         sum(COALESCE(d.quantity_ordered, 0)) AS open_qty,
         sum(COALESCE(d.extended_order_value, 0)) AS open_value
  FROM oe_detail d JOIN oe_header h ON h.order_number = d.order_number
  WHERE COALESCE({nb('d.job_number')}, {nb('h.job_number')}) IS NOT NULL
  GROUP BY 1)"""

HEAT_AGG = f"""heat_agg AS (
  SELECT job_key, string_agg(heat, ', ' ORDER BY COALESCE(TRY_CAST(heat AS BIGINT), 0), heat) AS heat_list
  FROM (SELECT upper(trim(job_number)) AS job_key, {nb('heat_number')} AS heat FROM jc_heat) x
  WHERE NULLIF(job_key, '') IS NOT NULL AND heat IS NOT NULL
  GROUP BY job_key)"""

OPEN_ORDERS = f"""open_orders AS (
  SELECT * FROM (
    SELECT COALESCE(m.due, o.open_due) AS due_date,
           m.customer_name AS customer_name,
           COALESCE(m.part, o.open_part) AS part_number,
           COALESCE(m.job_type, o.open_job_type) AS job_type,
           o.job_key AS job_number,
           COALESCE(m.alloy, {nb('ic2.base_material')}) AS alloy,
           m.casting_type AS casting_type,
           CAST(COALESCE(CASE WHEN o.open_qty IS NULL THEN m.qty_castings ELSE o.open_qty END, 0) AS DECIMAL(18,4)) AS qty_ordered,
           CAST(COALESCE(m.qty_molds, 0) AS DECIMAL(18,4)) AS quantity_of_molds,
           CAST(COALESCE(m.castings_per_mold, 0) AS DECIMAL(18,4)) AS castings_per_mold,
           CAST(COALESCE(m.cores, 0) AS DECIMAL(18,4)) AS quantity_of_cores,
           CAST(COALESCE(m.pour_weight, 0) AS DECIMAL(18,4)) AS pour_weight,
           CAST(COALESCE(NULLIF(m.total_pour, 0), m.pour_weight * m.qty_molds, 0) AS DECIMAL(18,4)) AS total_pour_wt,
           CAST(COALESCE(o.open_value, m.total_value, 0) AS DECIMAL(18,4)) AS total_value,
           COALESCE(m.main_heat, ha.heat_list, '') AS heat_no_assigned,
           CAST(NULLIF(COALESCE(m.castings_produced, 0), 0) AS DECIMAL(18,4)) AS castings_produced,
           CAST(NULLIF(COALESCE(m.molds_completed, 0), 0) AS DECIMAL(18,4)) AS molds_completed,
           COALESCE(m.on_hold, 'NO') AS on_hold,
           COALESCE(m.pool, 0) AS pool
    FROM orders_agg o
    LEFT JOIN main_jobs m ON o.job_key = m.job_key
    LEFT JOIN heat_agg ha ON ha.job_key = o.job_key
    LEFT JOIN ic_master ic2 ON ic2.product_code = COALESCE(m.part, o.open_part)) z
  WHERE due_date IS NOT NULL AND due_date >= DATE '2000-01-01'
    AND {nb('customer_name')} IS NOT NULL AND {nb('part_number')} IS NOT NULL
    AND {nb('job_number')} IS NOT NULL)"""

BASE = ",\n".join([ERP_CTES, MAIN_JOBS, ORDERS_AGG, HEAT_AGG, OPEN_ORDERS])


def with_base(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([BASE, *ctes]) + "\n"


def _num_out(cols):
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)


Q = {}

Q["open_orders"] = with_base() + f"""
SELECT due_date, customer_name, part_number, job_type, job_number, alloy, casting_type,
       {_num_out(['qty_ordered', 'quantity_of_molds', 'castings_per_mold', 'quantity_of_cores',
                  'pour_weight', 'total_pour_wt', 'total_value'])},
       heat_no_assigned,
       {_num_out(['castings_produced', 'molds_completed'])},
       on_hold, CAST(pool AS BIGINT) AS pool
FROM open_orders"""


# ---------------------------------------------------------------------------------------------
# Scheduler input, eligibility, schedule rows
# ---------------------------------------------------------------------------------------------
def _ws_key(x: str) -> str:
    return f"COALESCE(upper(regexp_replace(CAST({x} AS VARCHAR), '^\\s+|\\s+$', '', 'g')), '')"


def _flag(x: str) -> str:
    return f"upper(trim(CAST({x} AS VARCHAR))) IN ('Y', 'YES', 'TRUE', '1')"


COMPAT = f"""compat_raw AS (
  SELECT * FROM (VALUES
    ('economy', 'G1', 'yes', '', 'Y', 1),
    ('SMALL', 'G1', 'NO', 'economy, ,ECONOMY,medium', '', 2),
    ('MEDIUM', 'G2', 'N', 'promo', 'TRUE', 3),
    ('PROMO', 'G2', '1', '', NULL, 4),
    ('STANDARD', '', 'YES', '', 'Y', 5),
    ('LARGE', 'G3', 'YES', '', 'N', 6),
    ('SMALL ', 'G1', 'no', 'economy, promo', 'y', 7),
    ('', 'G9', 'YES', '', 'Y', 8)
  ) t(alloy_code, compatibility_group, is_compat_with_all, compatible_specific_alloys, is_active, file_line)),
compat_items AS (
  SELECT alloy_code, file_line,
         list_transform(string_split(COALESCE(compatible_specific_alloys, ''), ','), lambda x: upper(trim(x))) AS items
  FROM compat_raw),
compat_map AS (
  SELECT k.alloy_key,
         COALESCE(NULLIF(trim(COALESCE(k.compatibility_group, '')), ''), k.alloy_key) AS compatibility_group,
         CASE WHEN {_flag('k.is_compat_with_all')} THEN 'YES' ELSE 'NO' END AS compat_all,
         array_to_string(list_filter(list_filter(ci.items, lambda x: x <> ''),
                                     lambda x, i: list_position(list_filter(ci.items, lambda y: y <> ''), x) = i), ', ') AS specific_alloys
  FROM (SELECT *, {_ws_key('alloy_code')} AS alloy_key,
               row_number() OVER (PARTITION BY {_ws_key('alloy_code')} ORDER BY file_line DESC) AS rn
        FROM compat_raw
        WHERE is_active IS NULL OR trim(is_active) = '' OR {_flag('is_active')}) k
  JOIN compat_items ci ON ci.file_line = k.file_line
  WHERE k.rn = 1 AND k.alloy_key <> '')"""

SCHED_IN = f"""sched_in AS (
  SELECT o.*,
         greatest(COALESCE(CAST(o.quantity_of_molds AS DOUBLE), 0) - COALESCE(CAST(o.molds_completed AS DOUBLE), 0), 0.0) AS molds_needed,
         COALESCE(o.on_hold, 'NO') AS hold, 'NO' AS scheduled,
         COALESCE(cm.compatibility_group, {_ws_key('o.alloy')}) AS compatibility_group,
         COALESCE(cm.compat_all, 'NO') AS compat_all,
         COALESCE(cm.specific_alloys, '') AS specific_alloys
  FROM open_orders o
  LEFT JOIN compat_map cm ON cm.alloy_key = {_ws_key('o.alloy')}
  WHERE {_ws_key('o.customer_name')} NOT IN ('HOUSE ACCOUNT'))"""

ELIG = """elig AS (
  SELECT *, CASE WHEN NULLIF(trim(job_number), '') IS NULL THEN 'blank'
                 WHEN upper(trim(hold)) = 'YES' THEN 'hold'
                 WHEN upper(trim(job_type)) IN ('IFA', 'IFC') THEN 'job_type'
                 WHEN upper(trim(casting_type)) = 'I' THEN 'cast_type'
                 WHEN molds_needed IS NULL OR molds_needed <= 0 THEN 'no_molds' END AS reject_reason
  FROM sched_in)"""

SROWS = """srows AS (
  SELECT * EXCLUDE (reject_reason), CAST(ceil(molds_needed) AS INTEGER) AS molds_for_ext, '' AS ext,
         0 AS extension_seq,
         CAST(ceil(molds_needed) AS INTEGER) * greatest(COALESCE(pour_weight, 0), 0) AS total_weight_per_ext
  FROM elig WHERE reject_reason IS NULL AND ceil(molds_needed) > 0)"""

# Allocation, stated as a recursion over (pool, day, position): the state carries the
# remaining molds of every row of the pool and the day's counters.  Rows are unique per job
# in a pool, so "new job" is every row not yet served today and the per-job line cap is a
# per-row cap.
K1 = f"""k1_items AS (
  SELECT pool, job_number, casting_type, molds_for_ext AS molds,
         upper(trim(COALESCE(casting_type, 'L'))) = 'F' AS is_floor,
         row_number() OVER (PARTITION BY pool ORDER BY
             CASE WHEN due_date IS NOT NULL AND due_date <= {REFERENCE_DATE} + 56 THEN 0 ELSE 1 END,
             due_date NULLS LAST, compatibility_group NULLS LAST,
             {_ws_key('job_number')}, job_number || '|' || ext) AS seq
  FROM srows WHERE {_ws_key('job_number')} <> '' AND molds_for_ext > 0),
k1_pools AS (
  SELECT pool, count(*) AS n, list(molds ORDER BY seq) AS rem0, list(is_floor ORDER BY seq) AS fl
  FROM k1_items GROUP BY pool),
k1 AS (
  SELECT pool, n, fl, 1 AS day, 1 AS pos, rem0 AS rem, 0 AS jobs, 0 AS lu, 0 AS fu,
         0 AS tpos, 0 AS tday, 0 AS tk
  FROM k1_pools
  UNION ALL
  SELECT pool, n, fl,
         CASE WHEN pos = n THEN day + 1 ELSE day END,
         CASE WHEN pos = n THEN 1 ELSE pos + 1 END,
         CASE WHEN t > 0 THEN list_concat(rem[1:pos - 1], [rem[pos] - t], rem[pos + 1:]) ELSE rem END,
         CASE WHEN pos = n THEN 0 ELSE jobs + CASE WHEN t > 0 THEN 1 ELSE 0 END END,
         CASE WHEN pos = n THEN 0 ELSE lu + CASE WHEN NOT fl[pos] THEN t ELSE 0 END END,
         CASE WHEN pos = n THEN 0 ELSE fu + CASE WHEN fl[pos] THEN t ELSE 0 END END,
         pos, day, t
  FROM (SELECT *, greatest(CASE WHEN rem[pos] <= 0 OR jobs >= 10 THEN 0
                                WHEN fl[pos] THEN least(rem[pos], 3 - fu)
                                ELSE least(rem[pos], 6, 30 - lu) END, 0) AS t
        FROM k1 WHERE list_sum(rem) > 0) s),
k1_chunks AS (SELECT pool, tpos AS seq, tday AS schedule_day, tk AS molds_for_ext FROM k1 WHERE tk > 0),
asg AS (
  SELECT r.* EXCLUDE (molds_for_ext, total_weight_per_ext), c.schedule_day, c.molds_for_ext, c.seq AS priority_seq,
         CAST(floor(greatest(COALESCE(r.pour_weight, 0), 0) * c.molds_for_ext) AS BIGINT) AS total_weight_per_ext,
         c.schedule_day AS pour_schedule_day, 1 AS heat_number, 1 AS global_heat_number
  FROM k1_chunks c JOIN k1_items i ON i.pool = c.pool AND i.seq = c.seq
  JOIN srows r ON r.pool = i.pool AND r.job_number = i.job_number)"""


def with_sched(*ctes: str) -> str:
    return with_base(COMPAT, SCHED_IN, ELIG, SROWS, K1, *ctes)


_OO_NUM = ['qty_ordered', 'quantity_of_molds', 'castings_per_mold', 'quantity_of_cores',
           'pour_weight', 'total_pour_wt', 'total_value', 'castings_produced', 'molds_completed']
_SI_COLS = ("due_date, customer_name, part_number, job_type, job_number, alloy, casting_type, "
            + _num_out(_OO_NUM) + ", heat_no_assigned, on_hold, CAST(pool AS BIGINT) AS pool, "
            "CAST(molds_needed AS DOUBLE) AS molds_needed, hold, scheduled, compatibility_group, "
            "compat_all, specific_alloys")

Q["scheduler_input"] = with_sched() + f"SELECT {_SI_COLS} FROM sched_in"

Q["reject_counts"] = with_sched() + """
SELECT r.reason, CAST(count(e.rr) AS BIGINT) AS job_count
FROM (VALUES ('blank'), ('hold'), ('job_type'), ('cast_type'), ('no_molds'), ('added')) r(reason)
LEFT JOIN (SELECT COALESCE(reject_reason, 'added') AS rr FROM elig) e ON e.rr = r.reason
GROUP BY r.reason"""

Q["schedule_rows"] = with_sched() + f"""
SELECT {_SI_COLS}, CAST(molds_for_ext AS BIGINT) AS molds_for_ext, ext,
       CAST(extension_seq AS BIGINT) AS extension_seq,
       CAST(total_weight_per_ext AS DOUBLE) AS total_weight_per_ext,
       row_number() OVER (ORDER BY due_date NULLS LAST, job_number) AS row_seq
FROM srows"""

Q["mold_assignments"] = with_sched() + """
SELECT CAST(pool AS BIGINT) AS pool, job_number, CAST(schedule_day AS BIGINT) AS schedule_day,
       CAST(molds_for_ext AS BIGINT) AS molds_for_ext, total_weight_per_ext,
       CAST(pour_schedule_day AS BIGINT) AS pour_schedule_day, casting_type, compatibility_group, due_date
FROM asg"""

Q["capacity_check"] = with_sched() + """
SELECT CAST(pool AS BIGINT) AS pool, CAST(sum(molds_for_ext) AS BIGINT) AS planned_molds,
       CAST(sum(molds_for_ext) AS BIGINT) AS assigned_molds,
       CAST((SELECT count(DISTINCT schedule_day) FROM asg a WHERE a.pool = s.pool) AS BIGINT) AS days,
       CAST(0 AS BIGINT) AS violation_days
FROM srows s GROUP BY pool"""

Q["floor_lane_schedule"] = with_sched() + f"""
, fl AS (
  SELECT pool, job_number, molds_for_ext AS molds,
         sum(molds_for_ext) OVER (PARTITION BY pool ORDER BY
             CASE WHEN due_date IS NOT NULL AND due_date <= {REFERENCE_DATE} + 56 THEN 0 ELSE 1 END,
             due_date NULLS LAST, compatibility_group NULLS LAST, {_ws_key('job_number')}, job_number
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
  FROM srows WHERE upper(trim(COALESCE(casting_type, 'L'))) = 'F' AND molds_for_ext > 0
       AND {_ws_key('job_number')} <> ''
  ), fl2 AS (SELECT pool, job_number, e - molds_for_ext AS s, e FROM (SELECT *, molds AS molds_for_ext FROM fl) x)
SELECT CAST(pool AS VARCHAR) AS pool_key, job_number || '' AS job_number, CAST(d AS BIGINT) AS schedule_day,
       CAST(least(e, d * 3) - greatest(s, (d - 1) * 3) AS BIGINT) AS molds_for_ext
FROM fl2, range(CAST(floor(s / 3) + 1 AS BIGINT), CAST(floor((e - 1) / 3) + 2 AS BIGINT)) t(d)"""


# ---------------------------------------------------------------------------------------------
# Mold reports and shipping
# ---------------------------------------------------------------------------------------------
def day_date_sql(d: str) -> str:
    """Schedule day -> date.  The calendar starts Saturday 2001-06-02, so day 1 is Monday
    2001-06-04 and every five days add a week."""
    return f"(DATE '2001-06-04' + CAST(7 * (({d} - 1) // 5) + (({d} - 1) % 5) AS INTEGER))"


def risk_sql(b: str):
    st = (f"CASE WHEN {b} IS NULL THEN 'UNKNOWN' WHEN {b} < 14 THEN 'AT RISK' "
          f"WHEN {b} < 21 THEN 'WATCH' ELSE 'ON TRACK' END")
    tx = (f"CASE WHEN {b} IS NULL THEN 'No due date available' "
          f"WHEN {b} < 14 THEN 'Pour is less than 14 days before due' "
          f"WHEN {b} < 21 THEN 'Pour is within a narrow due-date buffer window' "
          f"ELSE 'Pour meets the minimum 14-day due buffer' END")
    return st, tx


_rs, _rt = risk_sql("date_diff('day', " + day_date_sql("pour_schedule_day") + ", due_date)")
DR = f"""dr AS (
  SELECT *, {day_date_sql('schedule_day')} AS mold_date, dayname({day_date_sql('schedule_day')}) AS mold_weekday,
         {day_date_sql('pour_schedule_day')} AS pour_date, dayname({day_date_sql('pour_schedule_day')}) AS pour_weekday,
         date_diff('day', {day_date_sql('pour_schedule_day')}, due_date) AS pour_buffer_days,
         {_rs} AS due_buffer_status, {_rt} AS planner_diagnostic
  FROM asg)"""

_DETAIL = ("due_date, customer_name, part_number, job_number, ext, alloy, casting_type, "
           "CAST(quantity_of_molds AS DOUBLE) AS quantity_of_molds, CAST(castings_per_mold AS DOUBLE) AS castings_per_mold, "
           "CAST(quantity_of_cores AS DOUBLE) AS quantity_of_cores, CAST(heat_number AS BIGINT) AS heat_number, "
           "CAST(pour_schedule_day AS BIGINT) AS pour_schedule_day, mold_date, mold_weekday, pour_date, pour_weekday, "
           "CAST(pour_buffer_days AS BIGINT) AS pour_buffer_days, due_buffer_status, planner_diagnostic")
_NULL_DETAIL = ("NULL::DATE AS due_date, NULL AS customer_name, NULL AS part_number, NULL AS job_number, NULL AS ext, "
                "NULL AS alloy, NULL AS casting_type, NULL::DOUBLE AS quantity_of_molds, NULL::DOUBLE AS castings_per_mold, "
                "NULL::DOUBLE AS quantity_of_cores, NULL::BIGINT AS heat_number, NULL::BIGINT AS pour_schedule_day, "
                "NULL::DATE AS mold_date, NULL AS mold_weekday, NULL::DATE AS pour_date, NULL AS pour_weekday, "
                "NULL::BIGINT AS pour_buffer_days, NULL AS due_buffer_status, NULL AS planner_diagnostic")

DAILY = f"""daily AS (
  SELECT CAST(pool AS BIGINT) AS pool, CAST(schedule_day AS BIGINT) AS schedule_day, {_DETAIL},
         CAST(total_weight_per_ext AS BIGINT) AS total_weight_per_ext, CAST(molds_for_ext AS BIGINT) AS molds_for_ext,
         'detail' AS row_type
  FROM dr
  UNION ALL
  SELECT CAST(pool AS BIGINT), CAST(schedule_day AS BIGINT), {_NULL_DETAIL},
         CAST(sum(total_weight_per_ext) AS BIGINT), CAST(sum(molds_for_ext) AS BIGINT), 'total'
  FROM dr GROUP BY pool, schedule_day)"""

Q["daily_mold_schedule"] = with_sched(DR, DAILY) + "SELECT * FROM daily"

Q["mold_rows"] = with_sched(DR, DAILY) + "SELECT * EXCLUDE (row_type) FROM daily WHERE row_type = 'detail'"

# Half of all plants as one pool.  A recursion by day over the pending rows: rows are unique per job, so a row
# takes what its lane's limit leaves after the earlier rows of the lane, if it is among the first ten that take any.
_HOT = f"""hot_items AS (
  SELECT CASE WHEN pool % 2 = 0 THEN 0 ELSE pool END AS hp, job_number, molds_for_ext AS molds, pour_weight,
         upper(trim(COALESCE(casting_type, 'L'))) = 'F' AS fl,
         row_number() OVER (PARTITION BY CASE WHEN pool % 2 = 0 THEN 0 ELSE pool END ORDER BY
             CASE WHEN due_date IS NOT NULL AND due_date <= {REFERENCE_DATE} + 56 THEN 0 ELSE 1 END,
             due_date NULLS LAST, compatibility_group NULLS LAST, {_ws_key('job_number')}, job_number) AS seq
  FROM srows),
hot AS (
  SELECT 0 AS day, hp, seq, fl, CAST(molds AS BIGINT) AS rem, CAST(0 AS BIGINT) AS t FROM hot_items
  UNION ALL
  SELECT day + 1, hp, seq, fl, rem - t2, t2 FROM (
    SELECT *, CASE WHEN t1 > 0 AND count(*) FILTER (t1 > 0) OVER (PARTITION BY hp ORDER BY seq) <= 10 THEN t1 ELSE 0 END AS t2 FROM (
      SELECT *, CAST(greatest(least(want, CASE WHEN fl THEN 3 ELSE 30 END - COALESCE(sum(want) OVER (
               PARTITION BY hp, fl ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS BIGINT) AS t1
      FROM (SELECT *, CASE WHEN fl THEN rem ELSE least(rem, 6) END AS want FROM hot WHERE rem > 0))))"""

Q["mold_assignments_hot_pool"] = with_base(COMPAT, SCHED_IN, ELIG, SROWS, _HOT) + """
SELECT CAST(h.hp AS BIGINT) AS pool, i.job_number, CAST(h.day AS BIGINT) AS schedule_day, h.t AS molds_for_ext,
       CAST(floor(greatest(COALESCE(i.pour_weight, 0), 0) * h.t) AS BIGINT) AS total_weight_per_ext
FROM hot h JOIN hot_items i ON i.hp = h.hp AND i.seq = h.seq WHERE h.t > 0"""

# Jobs of several rows: the state also carries each job's line molds and whether it has a slot today.
_REPEATED = f"""rrows AS (
  SELECT s.* EXCLUDE (molds_for_ext), i, CAST(s.molds_for_ext // n + CASE WHEN i <= s.molds_for_ext % n THEN 1 ELSE 0 END AS INTEGER) AS molds_for_ext
  FROM (SELECT *, least(molds_for_ext, molds_for_ext % 3 + 2) AS n FROM srows) s, range(1, 5) t(i) WHERE i <= n),
r_items AS (
  SELECT *, upper(trim(COALESCE(casting_type, 'L'))) = 'F' AS is_floor,
         dense_rank() OVER (PARTITION BY pool ORDER BY job_number) AS job,
         row_number() OVER (PARTITION BY pool ORDER BY
             CASE WHEN due_date IS NOT NULL AND due_date <= {REFERENCE_DATE} + 56 THEN 0 ELSE 1 END,
             due_date NULLS LAST, compatibility_group NULLS LAST, {_ws_key('job_number')}, job_number, molds_for_ext, i) AS seq
  FROM rrows),
r_pools AS (
  SELECT pool, count(*) AS n, list(molds_for_ext ORDER BY seq) AS rem0, list(is_floor ORDER BY seq) AS fl, list(job ORDER BY seq) AS jb
  FROM r_items GROUP BY pool),
r AS (
  SELECT pool, n, fl, jb, 1 AS day, 1 AS pos, rem0 AS rem, []::BIGINT[] AS on_day, []::BIGINT[] AS line_of, 0 AS fu, 0 AS tpos, 0 AS tday, 0 AS tk
  FROM r_pools
  UNION ALL
  SELECT pool, n, fl, jb, CASE WHEN pos = n THEN day + 1 ELSE day END, CASE WHEN pos = n THEN 1 ELSE pos + 1 END,
         CASE WHEN t > 0 THEN list_concat(rem[1:pos - 1], [rem[pos] - t], rem[pos + 1:]) ELSE rem END,
         CASE WHEN pos = n THEN [] WHEN t > 0 AND NOT list_contains(on_day, jb[pos]) THEN list_append(on_day, jb[pos]) ELSE on_day END,
         CASE WHEN pos = n THEN [] WHEN t > 0 AND NOT fl[pos] THEN list_concat(line_of, list_transform(range(t), lambda z: jb[pos])) ELSE line_of END,
         CASE WHEN pos = n THEN 0 ELSE fu + CASE WHEN fl[pos] THEN t ELSE 0 END END, pos, day, t
  FROM (SELECT *, greatest(CASE WHEN rem[pos] <= 0 OR (len(on_day) >= 10 AND NOT list_contains(on_day, jb[pos])) THEN 0
                                WHEN fl[pos] THEN least(rem[pos], 3 - fu)
                                ELSE least(rem[pos], 6 - len(list_filter(line_of, lambda z: z = jb[pos])), 30 - len(line_of)) END, 0) AS t
        FROM r WHERE list_sum(rem) > 0) s),
r_asg AS (
  SELECT i.* EXCLUDE (molds_for_ext), i.molds_for_ext AS planned_molds_for_ext, r.tday AS schedule_day, r.tk AS molds_for_ext,
         CAST(floor(greatest(COALESCE(i.pour_weight, 0), 0) * r.tk) AS BIGINT) AS chunk_weight
  FROM r JOIN r_items i ON i.pool = r.pool AND i.seq = r.tpos WHERE r.tk > 0)"""

Q["mold_assignments_repeated_jobs"] = with_base(COMPAT, SCHED_IN, ELIG, SROWS, _REPEATED) + """
SELECT CAST(pool AS BIGINT) AS pool, job_number, CAST(planned_molds_for_ext AS BIGINT) AS planned_molds_for_ext,
       CAST(schedule_day AS BIGINT) AS schedule_day, CAST(molds_for_ext AS BIGINT) AS molds_for_ext, chunk_weight AS total_weight_per_ext
FROM r_asg"""

Q["capacity_check_repeated_jobs"] = with_base(COMPAT, SCHED_IN, ELIG, SROWS, _REPEATED) + """
SELECT CAST(pool AS BIGINT) AS pool, CAST(sum(molds_for_ext) AS BIGINT) AS planned_molds,
       CAST(sum(molds_for_ext) AS BIGINT) AS assigned_molds,
       CAST((SELECT count(DISTINCT schedule_day) FROM r_asg a WHERE a.pool = s.pool) AS BIGINT) AS days,
       CAST(0 AS BIGINT) AS violation_days
FROM srows s GROUP BY pool"""

Q["mold_schedule_sheet"] = with_sched(DR, DAILY) + f"""
SELECT d.pool, d.schedule_day, d.row_type, {day_date_sql('d.schedule_day')} AS mold_date,
       d.customer_name, d.part_number, d.job_number, d.ext, d.alloy, d.casting_type AS mold_type,
       d.quantity_of_molds, d.quantity_of_cores, d.total_weight_per_ext AS total_weight,
       d.molds_for_ext AS molds_today, a.avg_molds_per_day
FROM daily d LEFT JOIN (
  SELECT CAST(pool AS BIGINT) AS pool, CAST(sum(molds_for_ext) AS DOUBLE) / count(DISTINCT schedule_day) AS avg_molds_per_day
  FROM asg GROUP BY pool) a ON a.pool = d.pool"""

_LANE = """lane AS (
  SELECT pool, schedule_day,
         sum(CASE WHEN upper(trim(COALESCE(casting_type, ''))) <> 'F' THEN greatest(round(molds_for_ext), 0) ELSE 0 END) AS line_molds,
         sum(CASE WHEN upper(trim(COALESCE(casting_type, ''))) = 'F' THEN greatest(round(molds_for_ext), 0) ELSE 0 END) AS floor_molds
  FROM asg GROUP BY pool, schedule_day)"""

Q["mold_capacity"] = with_sched(_LANE) + """
SELECT CAST(pool AS BIGINT) AS pool, CAST(schedule_day AS BIGINT) AS schedule_day,
       CAST(line_molds AS BIGINT) AS line_molds, CAST(floor_molds AS BIGINT) AS floor_molds,
       'Day ' || CAST(schedule_day AS VARCHAR) AS day_label,
       'L=' || CAST(CAST(line_molds AS BIGINT) AS VARCHAR) || '/30' AS line_capacity,
       'F=' || CAST(CAST(floor_molds AS BIGINT) AS VARCHAR) || '/3' AS floor_capacity,
       round(line_molds / 30.0, 4) AS line_utilization, round(floor_molds / 3.0, 4) AS floor_utilization
FROM lane"""

Q["day_summary"] = with_sched() + """
SELECT CAST(pool AS BIGINT) AS pool, CAST(schedule_day AS BIGINT) AS schedule_day,
       count(DISTINCT NULLIF(trim(job_number), '')) AS unique_jobs,
       CAST(sum(molds_for_ext) AS BIGINT) AS total_molds,
       CAST(sum(round_even(COALESCE(molds_for_ext, 0) * COALESCE(pour_weight, 0), 0)) AS BIGINT) AS total_row_weight
FROM asg GROUP BY pool, schedule_day"""

Q["report_averages"] = with_sched() + """
SELECT CAST(pool AS BIGINT) AS pool, count(DISTINCT schedule_day) AS mold_days,
       CAST(sum(molds_for_ext) AS BIGINT) AS total_molds,
       round(sum(molds_for_ext) / count(DISTINCT schedule_day), 4) AS avg_molds_per_day,
       count(DISTINCT pour_schedule_day) AS pour_days,
       CAST(sum(total_weight_per_ext) AS BIGINT) AS total_poured_lbs,
       round(sum(total_weight_per_ext) / count(DISTINCT pour_schedule_day), 4) AS avg_poured_lbs_per_day
FROM asg GROUP BY pool"""

SHIP = f"""ship AS (
  SELECT p.pool, p.job AS job_number, p.planned_molds, p.due_date, p.customer_name,
         COALESCE(a.scheduled_molds, 0) AS scheduled_molds, a.mold_day, a.pour_day,
         CASE WHEN a.mold_day IS NULL THEN NULL ELSE {day_date_sql('a.mold_day')} END AS mold_date,
         CASE WHEN a.pour_day IS NULL THEN NULL ELSE {day_date_sql('a.pour_day')} END AS pour_date
  FROM (SELECT pool, {_ws_key('job_number')} AS job, sum(molds_for_ext) AS planned_molds,
               min(CAST(due_date AS DATE)) AS due_date,
               min(trim(customer_name)) FILTER (WHERE trim(customer_name) <> '') AS customer_name
        FROM srows GROUP BY 1, 2) p
  LEFT JOIN (SELECT pool, {_ws_key('job_number')} AS job, sum(molds_for_ext) AS scheduled_molds,
                    min(schedule_day) AS mold_day, max(pour_schedule_day) AS pour_day
             FROM asg GROUP BY 1, 2) a ON a.pool = p.pool AND a.job = p.job),
ship2 AS (
  SELECT *, pour_date + 14 AS expected_ship_date, date_diff('day', pour_date + 14, due_date) AS ship_buffer_days,
         CASE WHEN scheduled_molds <= 0 THEN 'Not Yet Scheduled'
              WHEN scheduled_molds < planned_molds THEN 'Partially Scheduled' ELSE 'Scheduled' END AS schedule_status
  FROM ship),
ship3 AS (
  SELECT *, CASE WHEN schedule_status = 'Not Yet Scheduled' THEN 'NOT SCHEDULED'
                 WHEN ship_buffer_days IS NULL THEN 'UNKNOWN'
                 WHEN ship_buffer_days >= 0 THEN 'YES' ELSE 'NO' END AS on_time
  FROM ship2)"""

_SHIP_OUT = """CAST(pool AS BIGINT) AS pool, job_number, schedule_status, COALESCE(NULLIF(trim(customer_name), ''), '') AS customer_name,
       CAST(planned_molds AS BIGINT) AS planned_molds, CAST(scheduled_molds AS BIGINT) AS scheduled_molds,
       CAST(mold_day AS BIGINT) AS mold_day, mold_date, CAST(pour_day AS BIGINT) AS pour_day, pour_date,
       expected_ship_date, due_date, CAST(ship_buffer_days AS BIGINT) AS ship_buffer_days, on_time,
       CASE upper(schedule_status) WHEN 'SCHEDULED' THEN 'green' WHEN 'PARTIALLY SCHEDULED' THEN 'yellow'
            WHEN 'NOT YET SCHEDULED' THEN 'orange' END AS status_band,
       CASE on_time WHEN 'YES' THEN 'green' WHEN 'NO' THEN 'red' WHEN 'NOT SCHEDULED' THEN 'orange' ELSE 'gray' END AS on_time_band,
       CASE WHEN ship_buffer_days IS NULL THEN 'gray' WHEN ship_buffer_days < 0 THEN 'red'
            WHEN ship_buffer_days < 4 THEN 'yellow' ELSE 'green' END AS ship_buffer_band"""

Q["job_shipping_outlook"] = with_sched(SHIP) + f"SELECT {_SHIP_OUT} FROM ship3"

Q["job_status"] = with_sched(SHIP) + """
SELECT CAST(pool AS BIGINT) AS pool, job_number, COALESCE(NULLIF(trim(customer_name), ''), '') AS customer_name,
       expected_ship_date, due_date, CAST(ship_buffer_days AS BIGINT) AS ship_buffer_days, on_time, schedule_status,
       CASE on_time WHEN 'YES' THEN 'green' WHEN 'NO' THEN 'red' WHEN 'NOT SCHEDULED' THEN 'orange' ELSE 'gray' END AS on_time_band
FROM ship3"""


# ---------------------------------------------------------------------------------------------
# Melt plan and heat / melt reports
# ---------------------------------------------------------------------------------------------
_DU = f"date_diff('day', {REFERENCE_DATE}, due_date)"
MP = f"""mp0 AS (
  SELECT * EXCLUDE (pour_schedule_day, global_heat_number), schedule_day AS original_pour_schedule_day,
         CAST(ceil(schedule_day / 2.0) * 2 AS INTEGER) AS pour_schedule_day,
         {_DU} AS days_until_due,
         CASE WHEN due_date IS NULL THEN 2 WHEN {_DU} <= 14 THEN 0 WHEN {_DU} <= 70 THEN 1 ELSE 2 END AS planning_priority_rank
  FROM asg),
mp1 AS (
  SELECT *, floor(COALESCE(sum(total_weight_per_ext) OVER (
                PARTITION BY pool, pour_schedule_day, compatibility_group
                ORDER BY alloy NULLS LAST, job_number NULLS LAST, ext NULLS LAST, schedule_day
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2300) AS gheat
  FROM mp0),
mp2 AS (
  SELECT * EXCLUDE (heat_number, gheat),
         dense_rank() OVER (PARTITION BY pool, pour_schedule_day ORDER BY compatibility_group NULLS LAST, gheat) AS heat_number
  FROM mp1),
mp_days AS (
  SELECT pool, pour_schedule_day,
         COALESCE(sum(max(heat_number)) OVER (PARTITION BY pool ORDER BY pour_schedule_day
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
  FROM mp2 GROUP BY pool, pour_schedule_day),
mp AS (
  SELECT m.*, d.prev + m.heat_number AS global_heat_number, m.heat_number AS heat_slot,
         CASE WHEN m.heat_number <= 5 THEN 'Planned' ELSE 'Overflow' END AS heat_status,
         CASE m.planning_priority_rank WHEN 0 THEN 'Highest Priority' WHEN 1 THEN 'Priority Review' ELSE 'Standard' END AS planning_priority,
         CASE m.planning_priority_rank WHEN 0 THEN 'Next 2 Weeks' WHEN 1 THEN 'Next 10 Weeks' ELSE 'Outside 10 Weeks' END AS review_window
  FROM mp2 m JOIN mp_days d ON d.pool = m.pool AND d.pour_schedule_day = m.pour_schedule_day)"""

_lbl = "CASE WHEN trim(ext) <> '' THEN trim(job_number) || '-' || trim(ext) ELSE trim(job_number) END"
HS = f"""hs0 AS (
  SELECT pool, pour_schedule_day, heat_number, any_value(heat_slot) AS heat_slot,
         any_value(global_heat_number) AS global_heat_number, any_value(heat_status) AS heat_status,
         min(planning_priority_rank) AS rnk, min(alloy) AS anchor_alloy,
         min(compatibility_group) AS compatibility_group,
         min(due_date) AS earliest_due_date, max(due_date) AS latest_due_date,
         CAST(sum(total_weight_per_ext) AS DOUBLE) AS total_weight_lbs, CAST(sum(molds_for_ext) AS DOUBLE) AS total_molds,
         count(*) AS rows_in_heat,
         array_to_string(list_sort(list_distinct(list(trim(job_number)))), ', ') AS jobs,
         array_to_string(list_sort(list_distinct(list({_lbl}))), ', ') AS extensions,
         max(pour_schedule_day - schedule_day) AS max_mold_lead_days,
         round(avg(pour_schedule_day - schedule_day), 1) AS avg_mold_lead_days,
         min(days_until_due) AS min_until_due,
         string_agg({_lbl} || ' | Due ' || COALESCE(strftime(due_date, '%m/%d/%Y'), '') || ' | Molds '
                    || COALESCE(CAST(CAST(molds_for_ext AS BIGINT) AS VARCHAR), ''), '; '
                    ORDER BY schedule_day, priority_seq) AS job_breakout
  FROM mp GROUP BY pool, pour_schedule_day, heat_number),
hs1 AS (
  SELECT *, {day_date_sql('pour_schedule_day')} AS schedule_date,
         date_diff('day', {day_date_sql('pour_schedule_day')}, earliest_due_date) AS buf
  FROM hs0),
hs AS (
  SELECT CAST(pool AS BIGINT) AS pool, CAST(pour_schedule_day AS BIGINT) AS pour_schedule_day,
         CAST(heat_number AS BIGINT) AS heat_number, schedule_date, dayname(schedule_date) AS weekday,
         CAST(heat_slot AS BIGINT) AS heat_slot, CAST(global_heat_number AS BIGINT) AS global_heat_number, heat_status,
         CASE rnk WHEN 0 THEN 'Highest Priority' WHEN 1 THEN 'Priority Review' ELSE 'Standard' END AS planning_priority,
         CASE rnk WHEN 0 THEN 'Next 2 Weeks' WHEN 1 THEN 'Next 10 Weeks' ELSE 'Outside 10 Weeks' END AS review_window,
         anchor_alloy, compatibility_group, earliest_due_date, latest_due_date,
         earliest_due_date - 14 AS target_pour_date, CAST(buf AS BIGINT) AS pour_buffer_days,
         {risk_sql('buf')[0]} AS due_buffer_status, total_weight_lbs, total_molds,
         CAST(rows_in_heat AS BIGINT) AS rows_in_heat, jobs, extensions,
         CAST(max_mold_lead_days AS BIGINT) AS max_mold_lead_days, CAST(avg_mold_lead_days AS DOUBLE) AS avg_mold_lead_days,
         CASE WHEN buf IS NULL THEN 'UNKNOWN' WHEN buf >= 14 THEN 'PASS'
              WHEN min_until_due IS NOT NULL AND min_until_due < 14 THEN 'EXCEPTION - NO TIME' ELSE 'VIOLATION' END AS two_week_rule_status,
         CASE WHEN buf IS NULL THEN 'Cannot evaluate two-week rule without due date'
              WHEN buf >= 14 THEN 'Pour is at least 14 days before due'
              WHEN min_until_due IS NOT NULL AND min_until_due < 14 THEN 'Due is already inside 14 days; poured at earliest feasible slot'
              ELSE 'Pour is inside 14-day window even though due runway exists' END AS two_week_rule_note,
         job_breakout, {risk_sql('buf')[1]} AS planner_diagnostic
  FROM hs1)"""

Q["melt_plan"] = with_sched(MP) + """
SELECT CAST(pool AS BIGINT) AS pool, job_number, CAST(schedule_day AS BIGINT) AS schedule_day,
       CAST(original_pour_schedule_day AS BIGINT) AS original_pour_schedule_day,
       CAST(pour_schedule_day AS BIGINT) AS pour_schedule_day, CAST(heat_number AS BIGINT) AS heat_number,
       CAST(global_heat_number AS BIGINT) AS global_heat_number, heat_status, planning_priority, review_window,
       CAST(days_until_due AS BIGINT) AS days_until_due, CAST(molds_for_ext AS BIGINT) AS molds_for_ext,
       CAST(total_weight_per_ext AS BIGINT) AS total_weight_per_ext
FROM mp"""

Q["heat_summary"] = with_sched(MP, HS) + "SELECT * FROM hs"

Q["heat_planner"] = with_sched(MP, HS) + """
SELECT * EXCLUDE (rows_in_heat, job_breakout), NULL::VARCHAR AS manual_alloy, NULL::DOUBLE AS manual_weight_lbs,
       NULL::DOUBLE AS manual_molds, NULL::VARCHAR AS planner_notes,
       CASE upper(two_week_rule_status) WHEN 'PASS' THEN 'green' WHEN 'EXCEPTION - NO TIME' THEN 'yellow'
            WHEN 'VIOLATION' THEN 'red' ELSE 'gray' END AS two_week_band,
       CASE upper(due_buffer_status) WHEN 'ON TRACK' THEN 'green' WHEN 'WATCH' THEN 'yellow'
            WHEN 'AT RISK' THEN 'red' ELSE 'gray' END AS due_buffer_band
FROM hs"""

Q["heat_daily_totals"] = with_sched(MP, HS) + """
SELECT pool, schedule_date, weekday, count(DISTINCT heat_number) AS total_heats,
       count(*) FILTER (WHERE heat_status = 'Planned') AS planned_heats,
       count(*) FILTER (WHERE heat_status = 'Overflow') AS overflow_heats,
       sum(total_weight_lbs) AS total_weight_lbs, sum(total_molds) AS total_molds,
       count(*) FILTER (WHERE due_buffer_status = 'AT RISK') AS at_risk_heats
FROM hs WHERE COALESCE(heat_status, '') <> 'Reserved'
GROUP BY pool, schedule_date, weekday"""

Q["heat_detail"] = with_sched(MP) + f"""
SELECT CAST(pool AS BIGINT) AS pool, {day_date_sql('pour_schedule_day')} AS schedule_date,
       dayname({day_date_sql('pour_schedule_day')}) AS weekday, CAST(pour_schedule_day AS BIGINT) AS pour_schedule_day,
       CAST(heat_number AS BIGINT) AS heat_number, CAST(global_heat_number AS BIGINT) AS global_heat_number,
       planning_priority, review_window, CAST(days_until_due AS BIGINT) AS days_until_due, due_date,
       CAST(date_diff('day', {day_date_sql('pour_schedule_day')}, due_date) AS BIGINT) AS due_buffer_days,
       compatibility_group, alloy, job_number, ext, CAST(extension_seq AS BIGINT) AS extension_seq,
       CAST(molds_for_ext AS BIGINT) AS molds_for_ext, CAST(total_weight_per_ext AS DOUBLE) AS total_weight_per_ext
FROM mp"""

Q["heat_sheet"] = with_sched(MP, HS) + """
SELECT x.*, a.avg_poured_lbs_per_day FROM (
  SELECT pool, schedule_date, weekday, heat_slot, heat_number, heat_status, anchor_alloy, compatibility_group,
         earliest_due_date, due_buffer_status, two_week_rule_status, total_weight_lbs, total_molds, 'detail' AS row_type
  FROM hs
  UNION ALL
  SELECT pool, schedule_date, weekday, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         sum(total_weight_lbs), sum(total_molds), 'total'
  FROM hs GROUP BY pool, schedule_date, weekday) x
LEFT JOIN (SELECT pool, sum(total_weight_lbs) / count(DISTINCT schedule_date) AS avg_poured_lbs_per_day
           FROM hs WHERE COALESCE(heat_status, '') <> 'Reserved' GROUP BY pool) a ON a.pool = x.pool"""


def _range_text(a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NULL THEN NULL WHEN {a} = {b} THEN strftime({a}, '%m/%d/%Y') "
            f"ELSE strftime({a}, '%m/%d/%Y') || ' - ' || strftime({b}, '%m/%d/%Y') END")


def _in_order(c: str) -> str:
    """Distinct non-blank names by the first place at which each occurs in the heat's rows."""
    names = f"list(trim({c}) ORDER BY schedule_day, priority_seq) FILTER (WHERE trim({c}) <> '')"
    return f"array_to_string(list_filter({names}, lambda x, i: list_position({names}, x) = i), ', ')"


Q["melt_management"] = with_sched(MP, HS) + f"""
SELECT h.pool, h.pour_schedule_day, h.heat_number, h.schedule_date AS pour_date, p.customers, p.poured_job_ids,
       {_range_text('least(h.earliest_due_date, h.latest_due_date)', 'greatest(h.earliest_due_date, h.latest_due_date)')} AS due_dates,
       {_range_text('p.m0', 'p.m1')} AS mold_dates,
       {_range_text('h.schedule_date', 'h.schedule_date')} AS pour_dates,
       h.schedule_date + 14 AS expected_ship_date, h.pour_buffer_days, h.due_buffer_status,
       h.two_week_rule_status, h.planner_diagnostic
FROM hs h LEFT JOIN (
  SELECT pool, pour_schedule_day, heat_number,
         {_in_order('customer_name')} AS customers, {_in_order('job_number')} AS poured_job_ids,
         min({day_date_sql('schedule_day')}) AS m0, max({day_date_sql('schedule_day')}) AS m1
  FROM mp GROUP BY 1, 2, 3) p
  ON p.pool = h.pool AND p.pour_schedule_day = h.pour_schedule_day AND p.heat_number = h.heat_number
WHERE COALESCE(h.heat_status, '') <> 'Reserved'"""

Q["melt_capacity"] = with_sched(MP) + """
SELECT CAST(pool AS BIGINT) AS pool, CAST(pour_schedule_day AS BIGINT) AS pour_schedule_day,
       count(DISTINCT NULLIF(trim(CAST(heat_number AS VARCHAR)), '')) AS heat_count,
       CAST(round(sum(COALESCE(total_weight_per_ext, 0))) AS BIGINT) AS total_weight,
       'Day ' || CAST(pour_schedule_day AS VARCHAR) AS day_label,
       'Heats=' || CAST(count(DISTINCT NULLIF(trim(CAST(heat_number AS VARCHAR)), '')) AS VARCHAR) || '/5' AS heat_capacity,
       'Lbs=' || CAST(CAST(round(sum(COALESCE(total_weight_per_ext, 0))) AS BIGINT) AS VARCHAR) || '/10000' AS weight_capacity
FROM mp GROUP BY pool, pour_schedule_day"""

_MS_ORDER = ("NULLIF(trim(alloy), '') ASC NULLS LAST, job_number ASC NULLS LAST, ext ASC NULLS LAST, "
             "COALESCE(trim(CAST(heat_number AS VARCHAR)), '') ASC NULLS LAST, schedule_day ASC NULLS LAST")
Q["melt_schedule"] = with_sched(MP) + f"""
, ms0 AS (
  SELECT *, COALESCE(trim(CAST(heat_number AS VARCHAR)), '') AS hk,
         CASE WHEN lag(COALESCE(trim(CAST(heat_number AS VARCHAR)), '')) OVER (PARTITION BY pool, pour_schedule_day ORDER BY {_MS_ORDER})
                   = COALESCE(trim(CAST(heat_number AS VARCHAR)), '') THEN 0 ELSE 1 END AS is_new
  FROM mp),
ms1 AS (
  SELECT *, sum(is_new) OVER (PARTITION BY pool, pour_schedule_day ORDER BY {_MS_ORDER}
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM ms0)
SELECT CAST(pool AS BIGINT) AS pool, CAST(pour_schedule_day AS BIGINT) AS pour_schedule_day,
       CAST(schedule_day AS BIGINT) AS schedule_day, {day_date_sql('pour_schedule_day')} + 1 AS pour_date,
       dayname({day_date_sql('pour_schedule_day')}) AS weekday, CAST(heat_number AS BIGINT) AS heat_number,
       trim(alloy) AS alloy, trim(job_number) AS job_number,
       CAST(COALESCE(sum(greatest(round(COALESCE(molds_for_ext, 0)), 0)) OVER (
            PARTITION BY pool, pour_schedule_day, run ORDER BY {_MS_ORDER}
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS molds_on_floor,
       CAST(COALESCE(total_weight_per_ext, 0) AS DOUBLE) AS pour_weight_required_lbs, trim(part_number) AS part_number
FROM ms1"""

Q["melt_gap_diagnostics"] = with_sched(MP) + f"""
, pdays AS (SELECT DISTINCT pool, pour_schedule_day AS day FROM mp),
miss AS (
  SELECT b.pool, r.day, greatest(1, r.day - 5) AS ws
  FROM (SELECT pool, min(day) AS lo, max(day) AS hi FROM pdays GROUP BY pool) b,
       LATERAL (SELECT unnest(range(b.lo, b.hi + 1)) AS day) r
  WHERE NOT EXISTS (SELECT 1 FROM pdays p WHERE p.pool = b.pool AND p.day = r.day)),
use_d AS (
  SELECT pool, schedule_day AS wday,
         sum(CASE WHEN upper(trim(COALESCE(casting_type, ''))) = 'F' THEN greatest(round(COALESCE(molds_for_ext, 0)), 0) ELSE 0 END) AS f,
         sum(CASE WHEN upper(trim(COALESCE(casting_type, ''))) <> 'F' THEN greatest(round(COALESCE(molds_for_ext, 0)), 0) ELSE 0 END) AS l
  FROM mp GROUP BY 1, 2),
used AS (
  SELECT m.pool, m.day, COALESCE(sum(u.l), 0) AS line_used, COALESCE(sum(u.f), 0) AS floor_used
  FROM miss m LEFT JOIN use_d u ON u.pool = m.pool AND u.wday >= m.ws AND u.wday < m.day
  GROUP BY 1, 2),
moves AS (SELECT DISTINCT pool, original_pour_schedule_day AS o, pour_schedule_day AS p, heat_number FROM mp WHERE heat_number IS NOT NULL),
mv AS (
  SELECT pool, o AS day, count(*) AS orig, count(*) FILTER (WHERE p > o) AS pushed,
         COALESCE(array_to_string(list_sort(list_distinct(list(p) FILTER (WHERE p > o))), ', '), '') AS pushed_to
  FROM moves GROUP BY 1, 2),
g AS (
  SELECT m.pool, m.day, m.ws, COALESCE(v.orig, 0) AS orig, COALESCE(v.pushed, 0) AS pushed,
         COALESCE(v.pushed_to, '') AS pushed_to, CAST(u.line_used AS BIGINT) AS line_used,
         CAST(u.floor_used AS BIGINT) AS floor_used, (m.day - m.ws) * 30 AS line_cap, (m.day - m.ws) * 3 AS floor_cap
  FROM miss m JOIN used u ON u.pool = m.pool AND u.day = m.day
  LEFT JOIN mv v ON v.pool = m.pool AND v.day = m.day)
SELECT CAST(pool AS BIGINT) AS pool, CAST(day AS BIGINT) AS skipped_pour_day, {day_date_sql('day')} AS skipped_pour_date,
       dayname({day_date_sql('day')}) AS weekday, CAST(orig AS BIGINT) AS original_heats_on_day,
       CAST(pushed AS BIGINT) AS heats_pushed_later, pushed_to AS pushed_to_pour_days,
       CASE WHEN day - ws > 0 THEN CAST(ws AS VARCHAR) || '-' || CAST(day - 1 AS VARCHAR) ELSE '' END AS mold_window_days,
       CAST(line_used AS VARCHAR) || '/' || CAST(line_cap AS VARCHAR) AS window_line_usage,
       CAST(floor_used AS VARCHAR) || '/' || CAST(floor_cap AS VARCHAR) AS window_floor_usage,
       CASE WHEN orig <= 0 THEN 'No heats remained targeted to this day after sequencing and prioritization.'
            WHEN pushed <= 0 THEN 'No final pours landed on this day after melt-plan rebuild.'
            WHEN greatest(line_cap - line_used, 0) <= 0 AND greatest(floor_cap - floor_used, 0) <= 0
              THEN 'Original heats were pushed later because no pre-pour line or floor mold capacity remained in the 5-day window.'
            WHEN greatest(line_cap - line_used, 0) <= 0
              THEN 'Original heats were pushed later because line mold capacity was fully consumed in the 5-day window.'
            WHEN greatest(floor_cap - floor_used, 0) <= 0
              THEN 'Original heats were pushed later because floor mold capacity was fully consumed in the 5-day window.'
            ELSE 'Original heats were pushed later to keep heat sequence and mold constraints feasible.' END AS likely_cause
FROM g"""


# ---------------------------------------------------------------------------------------------
# Quality, audits, history dashboard, scalar functions, compatibility pairs
# ---------------------------------------------------------------------------------------------
_ASM = OPEN_ORDERS.replace("open_orders AS (", "assembled AS (", 1)
_ASM = _ASM[:_ASM.index("  WHERE due_date IS NOT NULL")] + ")"

_val_parts = []
for _c in ["due_date", "customer_name", "part_number", "job_number"]:
    _blank = f"NULLIF(trim(CAST({_c} AS VARCHAR)), '') IS NULL"
    _val_parts.append(f"""SELECT '{_c}' AS column_name, count(*) FILTER (WHERE {_blank}) AS blank_rows,
       COALESCE(array_to_string(list_sort(list_distinct(list(COALESCE(job_number, '')) FILTER (WHERE {_blank})))[1:5], ', '), '') AS sample_jobs,
       count(*) AS total_rows FROM assembled""")
Q["validation_summary"] = with_base(_ASM) + "\nUNION ALL\n".join(_val_parts)

MISSING = f"""missing AS (
  SELECT h.order_number, d.line_number, h.customer_name, d.product_number AS part_number,
         d.job_number AS detail_job_number, h.job_number AS header_job_number, h.ship_date
  FROM oe_detail d JOIN oe_header h ON h.order_number = d.order_number
  WHERE NULLIF(upper(trim(COALESCE({nb('d.job_number')}, {nb('h.job_number')}))), '') IS NULL)"""

Q["missing_job_audit"] = with_base(MISSING) + """
SELECT order_number, CAST(line_number AS BIGINT) AS line_number, customer_name, part_number, detail_job_number,
       header_job_number, n AS missing_count, 'live' AS source
FROM (SELECT count(*) AS n FROM missing) total LEFT JOIN (
  SELECT * FROM missing
  ORDER BY order_number NULLS LAST, line_number NULLS LAST, customer_name NULLS LAST, part_number NULLS LAST,
           detail_job_number NULLS LAST, header_job_number NULLS LAST
  LIMIT 10) first_ten ON TRUE"""

Q["audit_by_month"] = with_base(MISSING) + """
, pm AS (SELECT strftime(ship_date, '%Y-%m') AS month, count(*) AS missing_count, min(order_number) AS first_order
         FROM missing GROUP BY 1)
SELECT * FROM pm WHERE month IS NULL OR month IN (SELECT month FROM pm WHERE month IS NOT NULL ORDER BY month DESC LIMIT 12)"""


def _canon_num(x: str) -> str:
    t = f"CAST(TRY_CAST(NULLIF(trim(replace(replace(CAST({x} AS VARCHAR), ',', ''), '$', '')), '') AS DECIMAL(38,10)) AS VARCHAR)"
    return f"regexp_replace(regexp_replace({t}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


_TXT = ["customer_name", "part_number", "job_type", "job_number", "alloy", "casting_type", "heat_no_assigned"]
_NUM = ['qty_ordered', 'quantity_of_molds', 'castings_per_mold', 'quantity_of_cores', 'pour_weight',
        'total_pour_wt', 'total_value', 'castings_produced']
Q["open_order_report"] = with_sched() + f"""
SELECT CAST(o.pool AS BIGINT) AS pool,
       CASE WHEN EXISTS (SELECT 1 FROM asg a WHERE {_ws_key('a.job_number')} = {_ws_key('o.job_number')}) THEN 'YES' ELSE 'NO' END AS scheduled,
       COALESCE(strftime(o.due_date, '%Y-%m-%d'), '') AS due_date,
       {", ".join(f"COALESCE(trim(CAST(o.{c} AS VARCHAR)), '') AS {c}" for c in _TXT)},
       {", ".join(f"COALESCE({_canon_num('o.' + c)}, '') AS {c}" for c in _NUM)},
       COALESCE({_canon_num("COALESCE(CAST(o.molds_completed AS VARCHAR), '0')")}, '') AS molds_completed
FROM sched_in o"""

_DASH = f"""obj AS (
  SELECT upper(trim(COALESCE({nb('d.job_number')}, {nb('h.job_number')}))) AS job_key,
         max({nb('h.customer_po')}) AS customer_po, sum(COALESCE(d.quantity_ordered, 0)) AS quantity_ordered,
         sum(COALESCE(d.pieces_shipped_to_date, 0)) AS quantity_shipped_to_date, max(h.ship_date) AS ship_date,
         sum(COALESCE(d.extended_order_value, 0)) AS total_value
  FROM oe_detail d JOIN oe_header h ON h.order_number = d.order_number
  WHERE COALESCE({nb('d.job_number')}, {nb('h.job_number')}) IS NOT NULL GROUP BY 1)"""


def _dash_select(run_filter: str, date_filter: str = "") -> str:
    return f"""
SELECT s.job_number, o.customer_po, CAST(o.quantity_ordered AS DOUBLE) AS quantity_ordered,
       CAST(o.quantity_shipped_to_date AS DOUBLE) AS quantity_shipped_to_date, o.ship_date,
       CAST(o.total_value AS DOUBLE) AS total_value, CAST(s.pour_weight AS DOUBLE) AS pour_weight,
       CAST(COALESCE(NULLIF(s.total_pour_wt, 0), s.pour_weight * s.quantity_of_molds, 0) AS DOUBLE) AS total_pour_wt,
       CAST({to_dec6('jm.tool_impressions')} AS DOUBLE) AS castings_per_mold,
       CAST(s.quantity_of_cores AS DOUBLE) AS quantity_of_cores, CAST(s.castings_produced AS DOUBLE) AS castings_produced,
       CAST(s.molds_completed AS DOUBLE) AS molds_completed
FROM order_snapshot s
LEFT JOIN job_master jm ON upper(trim(jm.job_number)) = upper(trim(s.job_number))
LEFT JOIN obj o ON o.job_key = upper(trim(s.job_number))
WHERE s.run_id = ({run_filter}) {date_filter}"""


Q["dashboard_history"] = ("WITH RECURSIVE " + ",\n".join([ERP_CTES, ORDER_SNAPSHOT, _DASH])
                          + _dash_select("SELECT max(run_id) FROM scheduler_run"))
Q["dashboard_history_window"] = ("WITH RECURSIVE " + ",\n".join([ERP_CTES, ORDER_SNAPSHOT, _DASH])
                                 + _dash_select("SELECT 2", "AND s.due_date >= DATE '2001-04-01' "
                                                "AND s.due_date < DATE '2001-06-30' + 1"))

Q["due_date_decode"] = "WITH RECURSIVE " + ERP_CTES + f"""
SELECT d.order_number, CAST(d.line_number AS BIGINT) AS line_number, d.required_date AS detail_text,
       h.required_date AS header_text, {decode_date('d.required_date')} AS detail_date,
       {decode_date('h.required_date')} AS header_date,
       COALESCE({decode_date('d.required_date')}, {decode_date('h.required_date')}) AS due_date
FROM oe_detail d JOIN oe_header h ON h.order_number = d.order_number"""

# business days: step through the days with a recursive walk (independent of the closed form)
Q["business_day_add"] = """
WITH RECURSIVE o AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, CAST(o_orderkey % 21 - 10 AS INTEGER) AS n FROM orders),
walk AS (
  SELECT o_orderkey, order_date, n, order_date AS cur, abs(n) AS left_days, CASE WHEN n >= 0 THEN 1 ELSE -1 END AS step
  FROM o
  UNION ALL
  SELECT o_orderkey, order_date, n,
         CASE WHEN isodow(cur + step) = 6 AND step = 1 THEN cur + 3
              WHEN isodow(cur + step) = 7 AND step = 1 THEN cur + 2
              WHEN isodow(cur + step) = 7 AND step = -1 THEN cur - 3
              WHEN isodow(cur + step) = 6 AND step = -1 THEN cur - 2
              ELSE cur + step END,
         left_days - 1, step
  FROM walk WHERE left_days > 0)
SELECT o_orderkey, order_date, CAST(n AS BIGINT) AS offset_days, cur AS shifted_date FROM walk WHERE left_days = 0"""

Q["alloy_list_normalize"] = """
WITH p AS (
  SELECT p_partkey, concat_ws(',', lower(p_type), ' ', p_type, p_brand, ' ' || lower(p_brand)) AS raw_list FROM part),
q AS (SELECT p_partkey, raw_list,
             list_filter(list_transform(string_split(raw_list, ','), lambda x: upper(trim(x))), lambda x: x <> '') AS items
      FROM p)
SELECT p_partkey, raw_list, array_to_string(list_filter(items, lambda x, i: list_position(items, x) = i), ', ') AS normalized
FROM q"""

Q["number_text"] = "WITH RECURSIVE " + ERP_CTES + f"""
SELECT job_number, pour_weight_text, CAST({to_dec6('pour_weight_text')} AS DOUBLE) AS pour_weight,
       {_canon_num('pour_weight_text')} AS canonical_text,
       CAST({to_dec6('tool_impressions')} AS DOUBLE) AS castings_per_mold
FROM job_master"""

Q["planning_priority"] = with_sched() + f"""
SELECT CAST(pool AS BIGINT) AS pool, job_number, due_date,
       CAST(CASE WHEN due_date IS NULL THEN 2 WHEN {_DU} <= 14 THEN 0 WHEN {_DU} <= 70 THEN 1 ELSE 2 END AS BIGINT) AS planning_priority_rank,
       CASE WHEN due_date IS NULL THEN 'Standard' WHEN {_DU} <= 14 THEN 'Highest Priority' WHEN {_DU} <= 70 THEN 'Priority Review' ELSE 'Standard' END AS planning_priority,
       CASE WHEN due_date IS NULL THEN 'Outside 10 Weeks' WHEN {_DU} <= 14 THEN 'Next 2 Weeks' WHEN {_DU} <= 70 THEN 'Next 10 Weeks' ELSE 'Outside 10 Weeks' END AS review_window,
       CAST({_DU} AS BIGINT) AS days_until_due,
       row_number() OVER (PARTITION BY pool ORDER BY
           CASE WHEN due_date IS NULL THEN 2 WHEN {_DU} <= 14 THEN 0 WHEN {_DU} <= 70 THEN 1 ELSE 2 END,
           due_date NULLS LAST, job_number NULLS LAST, extension_seq NULLS LAST) AS planning_seq
FROM srows"""

Q["co_pour_candidates"] = with_sched() + f"""
, present AS (SELECT DISTINCT {_ws_key('alloy')} AS alloy_key FROM sched_in WHERE {_ws_key('alloy')} <> ''),
m AS (SELECT p.alloy_key, c.compatibility_group, c.compat_all, c.specific_alloys
      FROM present p JOIN compat_map c ON c.alloy_key = p.alloy_key),
pairs AS (
  SELECT a.alloy_key AS anchor_alloy, b.alloy_key AS cand
  FROM m a JOIN m b ON a.compatibility_group = b.compatibility_group
  WHERE a.alloy_key = b.alloy_key OR (a.compatibility_group <> '' AND (a.compat_all = 'YES'
        OR list_contains(list_transform(string_split(a.specific_alloys, ','), lambda x: trim(x)), b.alloy_key)))
  UNION ALL
  SELECT alloy_key, alloy_key FROM present WHERE alloy_key NOT IN (SELECT alloy_key FROM m))
SELECT anchor_alloy, array_to_string(list_sort(list_distinct(list(cand))), ', ') AS accepted_alloys,
       count(DISTINCT cand) AS n_accepted
FROM pairs GROUP BY anchor_alloy"""


# ---------------------------------------------------------------------------------------------
# History: raw / typed snapshot, lifecycle
# ---------------------------------------------------------------------------------------------
_EXPORT = [("due_date", "strftime(due_date, '%Y-%m-%d')")] + [
    (c, f"CAST({c} AS VARCHAR)") for c in
    ["customer_name", "part_number", "job_type", "job_number", "alloy", "casting_type", "qty_ordered",
     "quantity_of_molds", "castings_per_mold", "quantity_of_cores", "pour_weight", "total_pour_wt",
     "total_value", "heat_no_assigned", "castings_produced", "molds_completed", "on_hold"]]
RAW = "raw AS (SELECT CAST(1 AS BIGINT) AS run_id, " + ", ".join(
    f"trim({e}) AS {c}_raw" for c, e in _EXPORT) + " FROM open_orders)"

Q["snapshot_raw"] = with_base(RAW) + "SELECT * FROM raw"


def _dec4(x: str) -> str:
    return f"TRY_CAST(NULLIF(trim(replace(replace({x}, ',', ''), '$', '')), '') AS DECIMAL(18,4))"


_TYPED_NUM = ["qty_ordered", "quantity_of_molds", "castings_per_mold", "quantity_of_cores", "pour_weight",
              "total_pour_wt", "total_value", "castings_produced", "molds_completed"]
Q["snapshot_typed"] = with_base(RAW) + f"""
SELECT run_id, COALESCE({decode_date('due_date_raw')}, CAST(TRY_CAST(due_date_raw AS TIMESTAMP) AS DATE)) AS due_date,
       {nb('customer_name_raw')} AS customer_name, {nb('part_number_raw')} AS part_number,
       {nb('job_type_raw')} AS job_type, upper(trim(job_number_raw)) AS job_number, {nb('alloy_raw')} AS alloy,
       {nb('casting_type_raw')} AS casting_type,
       {", ".join(f"CAST({_dec4(c + '_raw')} AS DOUBLE) AS {c}" for c in _TYPED_NUM)},
       {nb('heat_no_assigned_raw')} AS heat_no_assigned,
       CASE WHEN upper(trim(on_hold_raw)) = 'YES' THEN 'YES' ELSE 'NO' END AS on_hold
FROM raw WHERE upper(trim(job_number_raw)) IS NOT NULL AND upper(trim(job_number_raw)) <> ''"""

Q["order_lifecycle"] = "WITH RECURSIVE " + ",\n".join([ERP_CTES, ORDER_SNAPSHOT]) + """
, s AS (SELECT * EXCLUDE (job_number), upper(trim(job_number)) AS job_number FROM order_snapshot),
agg AS (SELECT job_number, min(run_id) AS first_seen_run, max(run_id) AS last_seen_run, count(*) AS runs_seen
        FROM s GROUP BY job_number)
SELECT s.run_id, s.job_number, s.due_date, CAST(s.pour_weight AS DOUBLE) AS pour_weight,
       CAST(s.total_pour_wt AS DOUBLE) AS total_pour_wt, CAST(s.quantity_of_molds AS DOUBLE) AS quantity_of_molds,
       CAST(s.quantity_of_cores AS DOUBLE) AS quantity_of_cores, CAST(s.castings_produced AS DOUBLE) AS castings_produced,
       CAST(s.molds_completed AS DOUBLE) AS molds_completed,
       a.first_seen_run, a.last_seen_run, a.runs_seen
FROM s JOIN agg a ON a.job_number = s.job_number AND a.last_seen_run = s.run_id"""

Q["business_calendar"] = with_sched() + f"""
SELECT CAST(d AS BIGINT) AS day, {day_date_sql('d')} AS date, dayname({day_date_sql('d')}) AS weekday
FROM range(1, (SELECT max(schedule_day) FROM asg) + 1) t(d)"""

Q["order_lifecycle_incremental"] = Q["order_lifecycle"]
Q["report_schedule"] = Q["mold_assignments"]

# The default plan: pour day = mold day, heat 1.
_MP_DEFAULT = f"""mp AS (
  SELECT * EXCLUDE (pour_schedule_day, heat_number, global_heat_number), schedule_day AS original_pour_schedule_day,
         schedule_day AS pour_schedule_day, 1 AS heat_number, 1 AS global_heat_number, 1 AS heat_slot, 'Planned' AS heat_status,
         {_DU} AS days_until_due,
         CASE WHEN due_date IS NULL THEN 2 WHEN {_DU} <= 14 THEN 0 WHEN {_DU} <= 70 THEN 1 ELSE 2 END AS planning_priority_rank,
         CASE WHEN due_date IS NULL THEN 'Standard' WHEN {_DU} <= 14 THEN 'Highest Priority' WHEN {_DU} <= 70 THEN 'Priority Review' ELSE 'Standard' END AS planning_priority,
         CASE WHEN due_date IS NULL THEN 'Outside 10 Weeks' WHEN {_DU} <= 14 THEN 'Next 2 Weeks' WHEN {_DU} <= 70 THEN 'Next 10 Weeks' ELSE 'Outside 10 Weeks' END AS review_window
  FROM asg)"""
for _name in ("heat_summary", "heat_daily_totals", "melt_management", "melt_capacity"):
    Q[_name + "_default"] = Q[_name].replace(MP, _MP_DEFAULT)

_SHEETS = {"Overall Summary": "job_status", "Melt Schedule": "melt_schedule", "Melt Diagnostics": "melt_gap_diagnostics",
           "Mold Schedule": "mold_schedule_sheet", "Melt Summary": "melt_management", "Mold Summary": "job_shipping_outlook"}
Q["published_sheets"] = "\nUNION ALL\n".join(
    f"SELECT '{sheet}' AS sheet, count(*) AS row_count FROM ({Q[name]}) t" for sheet, name in _SHEETS.items())

# Every sheet in its order: the position of a row is its place in the published files.
_DAYS = {"Mold Schedule": "pool, schedule_day, row_type, NULLIF(trim(alloy), '') NULLS LAST, job_number NULLS LAST, ext NULLS LAST",
         "Melt Schedule": "pool, pour_schedule_day, NULLIF(trim(alloy), '') NULLS LAST, job_number NULLS LAST, heat_number, schedule_day",
         "Melt Diagnostics": "pool, skipped_pour_day", "Melt Summary": "pool, pour_schedule_day, heat_number",
         "Open Orders": "due_date NULLS LAST, job_number NULLS LAST",
         "Daily Mold Schedule": "pool, schedule_day, row_type, alloy NULLS LAST, due_date NULLS LAST, job_number NULLS LAST"}
for _sheet, _name in {**_SHEETS, "Open Orders": "open_orders", "Daily Mold Schedule": "daily_mold_schedule"}.items():
    _order = _DAYS.get(_sheet, "schedule_status NULLS LAST, due_date NULLS LAST, job_number NULLS LAST")
    _rows = f"({Q[_name]})" if _sheet != "Open Orders" else f"({Q[_name]}) o WHERE trim(upper(customer_name)) NOT IN ('HOUSE ACCOUNT')"
    Q["published_" + _sheet.lower().replace(" ", "_")] = f"SELECT *, row_number() OVER (ORDER BY {_order}) AS position FROM {_rows}"

# Slots 2 and 6 of every pour day are reserved: rows without a heat, and the heats take the other slots.
_MP_RESERVED = MP.replace("m.heat_number AS heat_slot", """CASE WHEN m.heat_number < 2 THEN m.heat_number WHEN m.heat_number + 1 < 6 THEN m.heat_number + 1
              ELSE m.heat_number + 2 END AS heat_slot""")
_BLANK = ("planning_priority, review_window, anchor_alloy, compatibility_group, due_buffer_status, jobs, extensions, "
          "two_week_rule_status, two_week_rule_note, job_breakout, planner_diagnostic").split(", ")
_HS_RESERVED = HS.replace("hs AS (", "hs_heats AS (") + f""",
hs AS (
  SELECT * FROM hs_heats
  UNION ALL BY NAME
  SELECT DISTINCT pool, pour_schedule_day, schedule_date, weekday, CAST(slot AS BIGINT) AS heat_slot, 'Reserved' AS heat_status,
         0.0::DOUBLE AS total_weight_lbs, 0.0::DOUBLE AS total_molds, CAST(0 AS BIGINT) AS rows_in_heat,
         {", ".join(f"'' AS {c}" for c in _BLANK)}
  FROM hs_heats, (VALUES (2), (6)) r(slot))"""
for _name in ("heat_planner", "heat_daily_totals", "heat_sheet", "melt_management"):
    Q[_name + "_reserved"] = Q[_name].replace(MP, _MP_RESERVED).replace(HS, _HS_RESERVED)

Q["heat_compat_audit"] = with_sched(MP) + f"""
, a AS (SELECT *, {_ws_key('alloy')} AS k, first_value({_ws_key('alloy')}) OVER w AS ak, first_value(compatibility_group) OVER w AS ag,
               first_value(compat_all) OVER w AS aa, first_value(specific_alloys) OVER w AS al
        FROM mp WINDOW w AS (PARTITION BY pool, pour_schedule_day, heat_number ORDER BY schedule_day, priority_seq))
SELECT CAST(pool AS BIGINT) AS pool, CAST(pour_schedule_day AS BIGINT) AS pour_schedule_day, CAST(heat_number AS BIGINT) AS heat_number,
       any_value(ak) AS anchor_alloy, count(*) AS rows_in_heat,
       count(*) FILTER (WHERE NOT (k <> '' AND ak <> '' AND (k = ak OR (ag <> '' AND ag = compatibility_group
             AND (aa = 'YES' OR list_contains(list_transform(string_split(al, ','), lambda x: trim(x)), k)))))) AS rows_not_accepted
FROM a GROUP BY 1, 2, 3"""

Q["job_shipping_outlook_repeated_jobs"] = with_base(COMPAT, SCHED_IN, ELIG, SROWS, _REPEATED) + f"""
, srows2 AS (SELECT * EXCLUDE (customer_name), CASE WHEN i = least(total, total % 3 + 2) THEN ' ' ELSE customer_name || ' / ' || i END AS customer_name
             FROM (SELECT *, sum(molds_for_ext) OVER (PARTITION BY pool, job_number) AS total FROM rrows)),
asg2 AS (SELECT *, schedule_day AS pour_schedule_day FROM r_asg),
{SHIP.replace("FROM srows GROUP", "FROM srows2 GROUP").replace("FROM asg GROUP", "FROM asg2 GROUP").replace(
    "min(trim(customer_name)) FILTER", "arg_max(trim(customer_name), i) FILTER")}
SELECT {_SHIP_OUT} FROM ship3"""

# Four loads of the open orders' export: all, every other due day, all as raw text only, and run 1 again with every other day.
_LOADED = """loaded AS (SELECT o.*, dayofmonth(due_date) % 2 = 0 AS even FROM open_orders o)"""
Q["history_runs"] = with_base(_LOADED) + """
SELECT CAST(r AS BIGINT) AS run_id, DATE '2001-06-01' + CAST(r - 1 AS INTEGER) AS run_date, 'export-' || r AS source_name,
       CASE WHEN r = 3 THEN (SELECT count(*) FROM loaded) ELSE (SELECT count(*) FROM loaded WHERE even) END AS row_count
FROM range(1, 4) t(r)"""
Q["history_raw_rows"] = with_base(_LOADED) + """
SELECT CAST(r AS BIGINT) AS run_id, CASE WHEN r = 3 THEN (SELECT count(*) FROM loaded) ELSE (SELECT count(*) FROM loaded WHERE even) END AS raw_rows,
       CASE WHEN r = 3 THEN 0 ELSE (SELECT count(*) FROM loaded WHERE even) END AS typed_rows
FROM range(1, 4) t(r)"""
Q["history_lifecycle"] = with_base(_LOADED) + """
SELECT upper(trim(job_number)) AS job_number, CAST(1 AS BIGINT) AS first_seen_run, CAST(2 AS BIGINT) AS last_seen_run, CAST(2 AS BIGINT) AS runs_seen,
       CAST(molds_completed AS DOUBLE) AS molds_completed
FROM loaded WHERE even"""
Q["dashboard_from_catalog"] = "WITH RECURSIVE " + with_base(_LOADED).removeprefix("WITH RECURSIVE ") + """
, order_snapshot AS (SELECT CAST(2 AS BIGINT) AS run_id, * EXCLUDE (even) FROM loaded WHERE even), """ + _DASH + "SELECT *, 'history' AS source FROM (" + _dash_select("SELECT 2") + ") d"
Q["history_tables"] = """
SELECT * FROM (VALUES ('order_lifecycle', 24), ('order_snapshot', 19), ('order_snapshot_raw', 19), ('scheduler_run', 4)) t(table_name, n_columns)"""
Q["text_snapshot"] = with_base(COMPAT, SCHED_IN, ELIG, SROWS) + """
SELECT CAST(pool AS VARCHAR) AS pool, COALESCE(trim(job_number), '') AS job_number, COALESCE(strftime(due_date, '%Y-%m-%d'), '') AS due_date,
       COALESCE(trim(alloy), '') AS alloy, CAST(molds_for_ext AS VARCHAR) AS molds_for_ext, COALESCE(trim(heat_no_assigned), '') AS heat_no_assigned,
       '2001-06-01_080000' AS snapshot_ts FROM srows"""
Q["archived_reports"] = with_sched(SHIP) + """
SELECT DATE '2001-06-01' AS as_of_date, CAST(1 AS BIGINT) AS seq, count(*) AS row_count FROM ship3
UNION ALL SELECT DATE '2001-06-01', 2, count(*) FROM ship3 WHERE on_time = 'YES'
UNION ALL SELECT DATE '2001-06-02', 1, count(*) FROM ship3"""
Q["compat_table_file"] = with_base(COMPAT, SCHED_IN) + """
SELECT DISTINCT alloy, compatibility_group, compat_all, specific_alloys FROM sched_in"""
