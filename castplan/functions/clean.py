"""Text, number and flag cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from castplan.schemas import HOLD_YES_GLYPH, TRUE_FLAG_WORDS

__all__ = [
    "col_", "blank_to_null", "norm_key", "norm_key_ws", "first_nonblank", "text_to_decimal",
    "hold_flag", "total_pour_fallback", "zero_to_null", "molds_needed", "to_number",
    "canonical_number_text", "plain_text", "yes_flag", "normalize_alloy_list", "ceil_int",
    "heat_key", "row_weight", "strip_headers", "with_defaults",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """``NULLIF(TRIM(x), '')`` — spaces only, like the ERP's LTRIM/RTRIM."""
    return F.nullif(F.trim(col_(c).cast("string")), F.lit(""))


def norm_key(c) -> Column:
    """Join key normalisation: trim spaces and upper-case."""
    return F.upper(F.trim(col_(c).cast("string")))


def norm_key_ws(c) -> Column:
    """Python-side key normalisation: strip any whitespace, upper-case; NULL becomes ''."""
    return F.coalesce(F.upper(F.regexp_replace(col_(c).cast("string"), r"^\s+|\s+$", "")),
                      F.lit(""))


def first_nonblank(*cols) -> Column:
    """First value that is not NULL or blank text."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def text_to_decimal(c, precision: int = 18, scale: int = 6, default=0) -> Column:
    """Text to decimal with ``,`` and ``$`` removed; unparseable or blank gives ``default``."""
    cleaned = F.nullif(F.trim(F.regexp_replace(col_(c).cast("string"), r"[,$]", "")), F.lit(""))
    value = cleaned.try_cast(f"decimal({precision},{scale})")
    return value if default is None else F.coalesce(value, F.lit(default).cast(f"decimal({precision},{scale})"))


def hold_flag(c) -> Column:
    """ERP hold glyph to YES/NO: the checked glyph is YES, anything else NO."""
    return F.when(blank_to_null(c) == F.lit(HOLD_YES_GLYPH), F.lit("YES")).otherwise(F.lit("NO"))


def total_pour_fallback(total, weight, molds) -> Column:
    """Recorded total pour weight, else weight x molds, else 0."""
    return F.coalesce(F.nullif(col_(total), F.lit(0)), col_(weight) * col_(molds), F.lit(0))


def zero_to_null(c) -> Column:
    return F.nullif(F.coalesce(col_(c), F.lit(0)), F.lit(0))


def to_number(c, default=0.0) -> Column:
    """Numeric coercion, bad or missing gives ``default`` (double)."""
    return F.coalesce(col_(c).cast("string").try_cast("double"), F.lit(default).cast("double"))


def molds_needed(quantity, completed) -> Column:
    """Remaining molds: max(quantity - completed, 0) on coerced numbers."""
    return F.greatest(to_number(quantity) - to_number(completed), F.lit(0.0))


def canonical_number_text(c) -> Column:
    """Canonical numeric text: strip ``,``/``$``, no trailing fractional zeros, bad -> NULL."""
    cleaned = F.nullif(F.trim(F.regexp_replace(col_(c).cast("string"), r"[,$]", "")), F.lit(""))
    as_text = cleaned.try_cast("decimal(38,10)").cast("string")
    stripped = F.regexp_replace(F.regexp_replace(as_text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(stripped == "-0", F.lit("0")).otherwise(stripped)


def plain_text(c, is_date: bool = False) -> Column:
    """Text rendering for text sinks: NULL -> '', dates as yyyy-MM-dd."""
    if is_date:
        return F.coalesce(F.date_format(col_(c), "yyyy-MM-dd"), F.lit(""))
    return F.coalesce(F.trim(col_(c).cast("string")), F.lit(""))


def yes_flag(c, default: bool = False) -> Column:
    """Y/YES/TRUE/1 flag (case-insensitive); blank or NULL gives ``default``."""
    v = F.upper(F.trim(col_(c).cast("string")))
    return (F.when(v.isNull() | (v == ""), F.lit(default))
            .otherwise(v.isin(*TRUE_FLAG_WORDS)))


def normalize_alloy_list(c) -> Column:
    """Comma list: split, trim + upper each item, drop blanks, dedupe keeping order, re-join."""
    items = F.transform(F.split(F.coalesce(col_(c).cast("string"), F.lit("")), ","),
                        lambda x: F.upper(F.trim(x)))
    return F.array_join(F.array_distinct(F.filter(items, lambda x: x != "")), ", ")


def ceil_int(c, default: int = 0) -> Column:
    """Ceil to int; NULL or unparseable gives ``default``."""
    return F.coalesce(F.ceil(col_(c).cast("string").try_cast("double")).cast("int"),
                      F.lit(default))


def heat_key(c) -> Column:
    """Heat id to a stable text key, blanks preserved as ''."""
    return F.coalesce(F.trim(col_(c).cast("string")), F.lit(""))


def row_weight(molds, pour_weight) -> Column:
    """molds x max(pour weight, 0); a missing weight counts as 0."""
    w = col_(pour_weight)
    return F.coalesce(col_(molds) * F.greatest(w, F.lit(0).cast("int")), F.lit(0))


def strip_headers(df):
    """Strip surrounding whitespace from every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def with_defaults(df, defaults: dict):
    """Add each missing column with its literal default (driven by ``df.columns``)."""
    missing = {k: F.lit(v) for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df
