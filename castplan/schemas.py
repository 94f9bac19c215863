"""Fixed schemas, column names and planning constants.

Column names are snake_case versions of the open-order report headers.  The constants below
are fixed values that must equal the planning rules being reproduced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Fixed values (planning rules).  Stated together and in natural order on purpose.
# ---------------------------------------------------------------------------------------------
LINE_MOLDS_PER_DAY = 30          # line (non-floor) molds per day
FLOOR_MOLDS_PER_DAY = 3          # floor molds per day
LINE_MOLDS_PER_JOB_PER_DAY = 6   # line molds one job may take per day
MAX_JOBS_PER_DAY = 10            # distinct jobs per day
URGENT_WINDOW_WEEKS = 8          # due within this many weeks is pulled forward first
HIGHEST_PRIORITY_WINDOW_DAYS = 14
PRIORITY_REVIEW_WINDOW_DAYS = 70
DAILY_WEIGHT_TARGET_LBS = 10000
MAX_PLANNED_HEATS_PER_DAY = 5
TARGET_POUR_LEAD_DAYS = 14
RISK_AT_RISK_BELOW_DAYS = 14
RISK_WATCH_BELOW_DAYS = 21
CLEANING_DAYS = 14
MOLD_LEAD_WINDOW_DAYS = 5
SHIP_BUFFER_TIGHT_BELOW_DAYS = 4
DAY_OFFSET_EPOCH = "1800-12-28"  # integer ERP dates count days from this date
MIN_VALID_DUE_DATE = "2000-01-01"
REJECT_JOB_TYPES = ("IFA", "IFC")
REJECT_CAST_TYPE = "I"
FLOOR_CAST_TYPE = "F"
TRUE_FLAG_WORDS = ("Y", "YES", "TRUE", "1")
HOLD_YES_GLYPH = "þ"          # the ERP's checked-box glyph
HOLD_NO_GLYPH = "o"
# House accounts are not production demand.  The list is site configuration; this neutral
# default is ours.
DEFAULT_HOUSE_ACCOUNTS = ("HOUSE ACCOUNT",)
REQUIRED_TEXT_COLUMNS = ("due_date", "customer_name", "part_number", "job_number")
AUDIT_RETENTION_MONTHS = 12


@dataclass(frozen=True)
class CapacityLimits:
    """Daily capacity of one pool.  One value is used by allocation and by the reports."""

    line_molds_per_day: int = LINE_MOLDS_PER_DAY
    floor_molds_per_day: int = FLOOR_MOLDS_PER_DAY
    line_molds_per_job_per_day: int = LINE_MOLDS_PER_JOB_PER_DAY
    max_jobs_per_day: int = MAX_JOBS_PER_DAY
    melt_heats_per_day: int = MAX_PLANNED_HEATS_PER_DAY
    melt_lbs_per_day: int = DAILY_WEIGHT_TARGET_LBS

    def __post_init__(self):
        for name in ("line_molds_per_day", "floor_molds_per_day",
                     "line_molds_per_job_per_day", "max_jobs_per_day"):
            if int(getattr(self, name)) < 1:
                raise ValueError(f"{name} must be >= 1")


def resolve_max_jobs_per_day(value, default: int = MAX_JOBS_PER_DAY) -> int:
    """Parse a max-jobs setting: bad text gives the default, values below 1 become 1."""
    try:
        parsed = int(str(value).strip())
    except (TypeError, ValueError):
        return default
    return max(parsed, 1)


# ---------------------------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------------------------
OPEN_ORDER_COLUMNS = [
    "due_date", "customer_name", "part_number", "job_type", "job_number", "alloy",
    "casting_type", "qty_ordered", "quantity_of_molds", "castings_per_mold",
    "quantity_of_cores", "pour_weight", "total_pour_wt", "total_value", "heat_no_assigned",
    "castings_produced", "molds_completed", "on_hold",
]

# Header text of the open-order report / ERP export, in report order.
OPEN_ORDER_HEADERS = [
    "Due Date", "Customer Name", "Part Number", "Job Type", "Job Number", "Alloy",
    "Casting Type", "QTY Ordered", "Quantity of Molds", "Castings Per Mold",
    "Quantity of Cores", "Pour Weight", "Total Pour WT", "Total Value", "Heat No Assigned",
    "Castings Produced", "Molds Completed", "On Hold",
]

HEADER_TO_COLUMN = dict(zip(OPEN_ORDER_HEADERS, OPEN_ORDER_COLUMNS))
HEADER_TO_COLUMN.update({"Hold": "hold", "Scheduled": "scheduled", "Molds Needed": "molds_needed", "Pool": "pool"})

NUMERIC_OPEN_ORDER_COLUMNS = [
    "qty_ordered", "quantity_of_molds", "castings_per_mold", "quantity_of_cores",
    "pour_weight", "total_pour_wt", "total_value", "castings_produced", "molds_completed",
]

DEC = T.DecimalType(18, 4)

OPEN_ORDERS_SCHEMA = T.StructType(
    [T.StructField("due_date", T.DateType()),
     T.StructField("customer_name", T.StringType()),
     T.StructField("part_number", T.StringType()),
     T.StructField("job_type", T.StringType()),
     T.StructField("job_number", T.StringType()),
     T.StructField("alloy", T.StringType()),
     T.StructField("casting_type", T.StringType())]
    + [T.StructField(c, DEC) for c in ["qty_ordered", "quantity_of_molds", "castings_per_mold",
                                       "quantity_of_cores", "pour_weight", "total_pour_wt",
                                       "total_value"]]
    + [T.StructField("heat_no_assigned", T.StringType()),
       T.StructField("castings_produced", DEC),
       T.StructField("molds_completed", DEC),
       T.StructField("on_hold", T.StringType())]
)

RAW_TEXT_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in OPEN_ORDER_HEADERS])

DASHBOARD_COLUMNS = [
    "job_number", "customer_po", "quantity_ordered", "quantity_shipped_to_date", "ship_date",
    "total_value", "pour_weight", "total_pour_wt", "castings_per_mold", "quantity_of_cores",
    "castings_produced", "molds_completed",
]

ALLOY_COMPAT_SCHEMA = T.StructType([
    T.StructField("alloy_code", T.StringType()),
    T.StructField("compatibility_group", T.StringType()),
    T.StructField("Is_Compat_with_All", T.StringType()),
    T.StructField("compatible_specific_alloys", T.StringType()),
    T.StructField("is_active", T.StringType()),
])

# Header aliases accepted for the compatibility reference file, first match wins.
COMPAT_ALIASES = {
    "alloy_code": ["alloy_code"],
    "compatibility_group": ["compatibility_group", "astm_group", "astm_code"],
    "compat_all": ["Is_Compat_with_All", "is_compat_with_all", "compat_with_all",
                   "compatible_with_all"],
    "specific_alloys": ["compatible_specific_alloys", "specific_compatible_alloys",
                        "compatible_with_specific_alloys"],
    "is_active": ["is_active", "active"],
}
COMPAT_REQUIRED = ("alloy_code", "compatibility_group", "compat_all")
