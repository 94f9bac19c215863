"""Alloy compatibility: reference-table cleaning, attachment to jobs, co-pour rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castplan.functions.clean import norm_key_ws, normalize_alloy_list, yes_flag
from castplan.schemas import COMPAT_ALIASES, COMPAT_REQUIRED

def resolve_compat_columns(df: DataFrame) -> DataFrame:
    """Rename the first present alias of each field to its canonical name.

    Raises ``RuntimeError`` naming the accepted aliases when a required field is absent.
    Adds ``file_line`` (input order) when the reader did not provide one.
    """
    df = df.toDF(*[c.strip() for c in df.columns])
    out = {}
    for field, aliases in COMPAT_ALIASES.items():
        hit = next((a for a in aliases if a in df.columns), None)
        if hit is None and field in COMPAT_REQUIRED:
            raise RuntimeError("Alloy compatibility table is missing required columns: "
                               + ", ".join(aliases))
        out[field] = F.col(f"`{hit}`") if hit else F.lit(None).cast("string")
    if "file_line" not in df.columns:
        df = df.withColumn("file_line", F.monotonically_increasing_id())
    return df.select(*[c.alias(k) for k, c in out.items()], "file_line")


def compat_map(raw: DataFrame) -> DataFrame:
    """Clean compatibility rows: active rows only (blank = active), normalised alloy key,
    group defaulting to the alloy, YES/NO flag, normalised specific list, last row per alloy.

    Output: ``alloy_key, compatibility_group, compat_all, specific_alloys``.
    """
    df = resolve_compat_columns(raw)
    df = df.where(yes_flag("is_active", default=True))
    df = df.withColumn("alloy_key", norm_key_ws("alloy_code")).where(F.col("alloy_key") != "")
    w = Window.partitionBy("alloy_key").orderBy(F.desc("file_line"))
    df = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    group = F.nullif(F.trim(F.coalesce(F.col("compatibility_group").cast("string"), F.lit(""))), F.lit(""))
    return df.select(
        "alloy_key",
        F.coalesce(group, F.col("alloy_key")).alias("compatibility_group"),
        F.when(yes_flag("compat_all", default=False), "YES").otherwise("NO").alias("compat_all"),
        normalize_alloy_list("specific_alloys").alias("specific_alloys"))


def attach_compat(df: DataFrame, compat: DataFrame, alloy_col: str = "alloy") -> DataFrame:
    """Attach compatibility group / accept-all flag / specific list by alloy.

    Unmapped alloys get their own key as group, ``NO`` and ``''``.
    """
    c = compat.select(F.col("alloy_key").alias("_ck"),
                               F.col("compatibility_group").alias("_cg"),
                               F.col("compat_all").alias("_ca"),
                               F.col("specific_alloys").alias("_cs"))
    key = norm_key_ws(alloy_col)
    j = df.withColumn("_ak", key).join(c, F.col("_ak") == F.col("_ck"), "left")
    return (j.withColumns({
        "compatibility_group": F.coalesce(F.col("_cg"), F.col("_ak")),
        "compat_all": F.coalesce(F.col("_ca"), F.lit("NO")),
        "specific_alloys": F.coalesce(F.col("_cs"), F.lit("")),
    }).drop("_ak", "_ck", "_cg", "_ca", "_cs"))


def can_share_heat(anchor_key, cand_key, anchor_group, cand_group, anchor_all, anchor_list):
    """Directional co-pour predicate as a Column: same alloy, or same group and the anchor
    accepts all of its group or lists the candidate.  Blank alloys never match."""
    a, b = F.col(anchor_key) if isinstance(anchor_key, str) else anchor_key, \
        F.col(cand_key) if isinstance(cand_key, str) else cand_key
    listed = F.array_contains(F.transform(F.split(anchor_list, ","), lambda x: F.trim(x)), b)
    return ((a != "") & (b != "")
            & ((a == b) | ((anchor_group != "") & (anchor_group == cand_group)
                           & ((anchor_all == "YES") | listed))))


def heat_compat_audit(plan: DataFrame) -> DataFrame:
    """Per heat: the anchor alloy (of the heat's first row), the rows, and the rows whose alloy the anchor can't
    share a heat with.  The anchors, one row a heat, are joined back to the heats' rows."""
    from castplan.operators.heats import plan_order

    keys = ["pool", "pour_schedule_day", "heat_number"]
    row = plan.withColumn("_key", norm_key_ws("alloy"))
    anchor = row.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.min_by(F.struct("_key", "compatibility_group", "compat_all", "specific_alloys"), plan_order(plan)).alias("a"))
    j = row.join(anchor, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "inner")
    fits = can_share_heat(F.col("a._key"), F.col("_key"), F.col("a.compatibility_group"), F.col("compatibility_group"),
                          F.col("a.compat_all"), F.col("a.specific_alloys"))
    return j.groupBy(*keys).agg(F.first("a._key").alias("anchor_alloy"), F.count(F.lit(1)).alias("rows_in_heat"),
                                F.count_if(~F.coalesce(fits, F.lit(False))).alias("rows_not_accepted"))


def co_pour_candidates(alloys: DataFrame, compat: DataFrame, alloy_col: str = "alloy") -> DataFrame:
    """For each distinct alloy present in ``alloys``, the alloys present that it can accept.

    No pairs are formed: each compatibility group's present members are gathered once (a
    list bounded by the alloy vocabulary), every anchor joins its own group's single row,
    and the accepted set is the whole member list (accept-all anchors) or the members that
    the anchor lists, plus the anchor itself.  Unmapped alloys accept only themselves.
    Output: ``anchor_alloy, accepted_alloys`` (sorted, comma separated), ``n_accepted``.
    """
    present = (alloys.select(norm_key_ws(alloy_col).alias("alloy_key"))
               .where(F.col("alloy_key") != "").distinct())
    m = present.join(compat, "alloy_key", "left")
    members = (m.where(F.col("compatibility_group").isNotNull() & (F.col("compatibility_group") != ""))
               .groupBy("compatibility_group").agg(F.collect_set("alloy_key").alias("_members")))
    j = m.join(members, "compatibility_group", "left")
    own = F.array(F.col("alloy_key"))
    listed = F.transform(F.split(F.coalesce(F.col("specific_alloys"), F.lit("")), ","), lambda x: F.trim(x))
    group_part = (F.when(F.col("compat_all") == "YES", F.col("_members"))
                  .otherwise(F.array_intersect(F.col("_members"), listed)))
    accepted = F.array_sort(F.array_union(own, F.coalesce(group_part, F.array().cast("array<string>"))))
    return j.select(F.col("alloy_key").alias("anchor_alloy"),
                    F.array_join(accepted, ", ").alias("accepted_alloys"),
                    F.size(accepted).cast("long").alias("n_accepted"))
