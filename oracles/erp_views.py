"""DuckDB definitions of the ERP-shaped views (same arithmetic as castplan.sources.adapter)."""


def decode_date(x: str) -> str:
    """The first that converts: ISO text (a time may follow), the first eight characters as
    yyyymmdd, a whole number of days from 1800-12-28 (also before it)."""
    t = f"trim(CAST({x} AS VARCHAR))"
    return (f"COALESCE(CASE WHEN regexp_full_match({t}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?)?') "
            f"THEN TRY_CAST(left({t}, 10) AS DATE) END, "
            f"CASE WHEN regexp_full_match(left({t}, 8), '[0-9]{{8}}') THEN CAST(try_strptime(left({t}, 8), '%Y%m%d') AS DATE) END, "
            f"CASE WHEN regexp_full_match({t}, '[+-]?[0-9]+') AND TRY_CAST({t} AS INTEGER) BETWEEN -657432 AND 2994626 "
            f"THEN DATE '1800-12-28' + TRY_CAST({t} AS INTEGER) END)")


def nb(x: str) -> str:
    """NULLIF(TRIM(x), '')."""
    return f"NULLIF(trim(CAST({x} AS VARCHAR)), '')"


def to_dec6(x: str) -> str:
    return (f"COALESCE(TRY_CAST(NULLIF(trim(replace(replace(CAST({x} AS VARCHAR), ',', ''), '$', '')), '') "
            f"AS DECIMAL(18,6)), 0)")


def _encode(d: str, sel: str) -> str:
    return (f"CASE WHEN {sel} = 0 THEN strftime({d}, '%Y-%m-%d') "
            f"WHEN {sel} = 1 THEN strftime({d}, '%Y%m%d') "
            f"WHEN {sel} = 2 THEN CAST(date_diff('day', DATE '1800-12-28', {d}) AS VARCHAR) "
            f"WHEN {sel} = 3 THEN 'TBD' "
            f"WHEN {sel} = 5 THEN strftime({d}, '%Y-%m-%dT08:30:00') "
            f"WHEN {sel} = 6 THEN strftime({d}, '%Y%m%d') || ' rush' "
            f"WHEN {sel} = 7 THEN strftime({d}, '%Y-%m-%d') || 'xyz' "
            f"WHEN {sel} = 8 THEN '-400' END")


OE_HEADER = f"""oe_header AS (
  SELECT o.o_orderkey AS order_number, c.c_name AS customer_name,
         CASE WHEN o.o_orderkey % 9 = 0 THEN '' ELSE 'PO-' || CAST(o.o_orderkey AS VARCHAR) END AS customer_po,
         CAST(o.o_orderdate AS DATE) + 30 AS ship_date,
         CASE WHEN o.o_orderkey % 4 = 0 THEN 'J' || CAST(o.o_orderkey % 1000 AS VARCHAR) ELSE '' END AS job_number,
         {_encode("(CAST(o.o_orderdate AS DATE) + 90)", "o.o_orderkey % 9")} AS required_date
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)"""

OE_DETAIL = f"""oe_detail AS (
  SELECT l_orderkey AS order_number, l_linenumber AS line_number,
         CAST(l_partkey AS VARCHAR) || CASE WHEN l_partkey % 2 = 0 THEN ' ' ELSE '' END AS product_number,
         CASE WHEN l_linenumber = 1 THEN 'JOB' END AS job_type,
         CAST(l_quantity AS DECIMAL(18,4)) AS quantity_ordered,
         CAST(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0.0 END AS DECIMAL(18,4)) AS pieces_shipped_to_date,
         CAST(l_extendedprice AS DECIMAL(18,4)) AS extended_order_value,
         CASE WHEN l_partkey % 50 = 0 THEN '' WHEN l_partkey % 50 = 1 THEN '   '
              ELSE ' j' || CAST(l_partkey AS VARCHAR) END AS job_number,
         {_encode("(CAST(l_shipdate AS DATE) + 45)", "(l_orderkey + l_linenumber) % 10")} AS required_date
  FROM lineitem)"""

JOB_MASTER = f"""job_master AS (
  SELECT CASE WHEN p.p_partkey % 7 = 0 THEN 'j' || CAST(p.p_partkey AS VARCHAR) || ' '
              ELSE 'J' || CAST(p.p_partkey AS VARCHAR) END AS job_number,
         CASE WHEN p.p_partkey % 13 = 0 THEN 'C' ELSE 'I' END AS job_status_flag,
         CASE WHEN p.p_partkey % 23 = 0 THEN NULL ELSE CAST(p.p_partkey AS VARCHAR) END AS product_code,
         CASE WHEN p.p_partkey % 31 = 0 THEN ' House Account ' WHEN p.p_partkey % 37 = 0 THEN '  '
              ELSE c.c_name END AS customer_name,
         CASE WHEN p.p_partkey % 20 = 0 THEN 'IFA' WHEN p.p_partkey % 20 = 1 THEN 'ifc' ELSE 'JOB' END AS job_type,
         CASE WHEN p.p_partkey % 9 = 0 THEN 'F' WHEN p.p_partkey % 9 = 1 THEN 'I'
              WHEN p.p_partkey % 9 = 2 THEN ' f ' WHEN p.p_partkey % 9 = 3 THEN NULL ELSE 'L' END AS casting_type,
         CASE WHEN p.p_partkey % 11 = 0 THEN 'þ' WHEN p.p_partkey % 11 = 1 THEN 'o' END AS job_on_hold,
         CAST(p.p_size * 2 AS DECIMAL(18,4)) AS quantity_required,
         CASE WHEN p.p_size % 10 = 9 THEN 'n/a' ELSE CAST(p.p_size % 6 AS VARCHAR) END AS tool_impressions,
         CAST(p.p_partkey % 17 + 1 AS DECIMAL(18,4)) AS molds_required,
         CAST(p.p_size % 4 AS VARCHAR) AS cores_text,
         CASE WHEN p.p_partkey % 4 = 0 THEN '$' || CAST(p.p_retailprice AS VARCHAR)
              WHEN p.p_partkey % 4 = 1 THEN '1,' || CAST(p.p_retailprice AS VARCHAR)
              WHEN p.p_partkey % 4 = 2 THEN CAST(p.p_retailprice AS VARCHAR) ELSE 'n/a' END AS pour_weight_text,
         CAST(CASE WHEN p.p_partkey % 6 = 0 THEN p.p_retailprice * 3 ELSE 0.0 END AS DECIMAL(18,4)) AS pour_quantity,
         CAST(CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE p.p_retailprice * 10 END AS DECIMAL(18,4)) AS contract_revised_amount,
         CAST(p.p_retailprice * 9 AS DECIMAL(18,4)) AS contract_original_amount,
         CAST((p.p_partkey % 5) * 2 AS DECIMAL(18,4)) AS quantity_produced,
         CAST(p.p_partkey % 5 AS DECIMAL(18,4)) AS molds_produced,
         CASE WHEN p.p_partkey % 8 = 0 THEN 'H' || CAST(p.p_partkey AS VARCHAR) END AS heat_number,
         CASE WHEN p.p_partkey % 3 = 0 THEN strftime(DATE '2001-05-01' + CAST(p.p_partkey % 120 AS INTEGER), '%Y-%m-%d') END AS due_date_text,
         CAST(p.p_partkey // 80 AS INTEGER) AS pool
  FROM part p LEFT JOIN customer c ON p.p_partkey % 100 + 1 = c.c_custkey)"""

IC_MASTER = """ic_master AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_code,
         CASE WHEN p_partkey % 29 = 0 THEN '' ELSE p_type END AS base_material
  FROM part)"""

JC_HEAT = """jc_heat AS (
  SELECT 'J' || CAST(l_partkey AS VARCHAR) AS job_number,
         CASE WHEN l_suppkey % 7 = 0 THEN 'X' || CAST(l_suppkey % 3 AS VARCHAR)
              ELSE CAST(l_suppkey % 12 AS VARCHAR) END AS heat_number
  FROM lineitem)"""

ORDER_SNAPSHOT = """order_snapshot AS (
  SELECT CAST(r.run_id AS BIGINT) AS run_id,
         CASE WHEN p_partkey % 7 = 0 THEN 'j' || CAST(p_partkey AS VARCHAR) || ' '
              ELSE 'J' || CAST(p_partkey AS VARCHAR) END AS job_number,
         CASE WHEN p_partkey % 3 = 0 THEN DATE '2001-05-01' + CAST(p_partkey % 120 AS INTEGER)
              ELSE DATE '2001-01-01' + CAST(p_partkey % 200 AS INTEGER) END AS due_date,
         CAST(p_retailprice AS DECIMAL(18,4)) AS pour_weight,
         CAST(CASE WHEN p_partkey % 6 = 0 THEN p_retailprice * 3 ELSE 0.0 END AS DECIMAL(18,4)) AS total_pour_wt,
         CAST(p_partkey % 17 + 1 AS DECIMAL(18,4)) AS quantity_of_molds,
         CAST(p_size % 4 AS DECIMAL(18,4)) AS quantity_of_cores,
         CAST((p_partkey % 5) * 2 * r.run_id AS DECIMAL(18,4)) AS castings_produced,
         CAST(p_partkey % 5 + r.run_id - 1 AS DECIMAL(18,4)) AS molds_completed
  FROM part CROSS JOIN (SELECT unnest(range(1, 4)) AS run_id) r
  WHERE p_partkey % 5 + r.run_id - 1 < p_partkey % 17 + 1),
scheduler_run AS (SELECT run_id, count(*) AS row_count FROM order_snapshot GROUP BY run_id)"""

ERP_CTES = ",\n".join([OE_HEADER, OE_DETAIL, JOB_MASTER, IC_MASTER, JC_HEAT])
