"""Type coercion of free-form text; anything that does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import c, finite

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def parse_bool(x) -> Column:
    t = F.lower(F.trim(c(x)))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def parse_double(x) -> Column:
    t = F.trim(c(x))
    return finite(F.when(t.rlike(NUMBER), t).try_cast("double"))


def parse_decimal(x, scale: int = 4) -> Column:
    t = F.trim(c(x))
    return F.when(t.rlike(NUMBER), t).try_cast(f"decimal(18,{scale})")


def parse_int(x) -> Column:
    """Accepts '12.0' and truncates toward zero."""
    return parse_double(x).try_cast("bigint")


def parse_timestamp(x) -> Column:
    """ISO text; a value without an offset is UTC."""
    return F.nullif(F.trim(c(x)), F.lit("")).try_cast("timestamp")


def parse_date(x) -> Column:
    t = F.split(F.nullif(F.trim(c(x)), F.lit("")), "T")[0]
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).try_cast("date")


def normalize_id(x) -> Column:
    """Trimmed text; a whole number written as a float loses its '.0'; empty is null."""
    t = F.nullif(F.trim(c(x)), F.lit(""))
    return F.when(t.rlike(r"^\d+\.0$"), F.regexp_replace(t, r"\.0$", "")).otherwise(t)


def normalize_pick(pick, p) -> Column:
    t = F.upper(F.trim(c(pick)))
    return F.when(t.isin("OVER", "UNDER"), t).when(c(p).isNotNull(), F.when(c(p) >= 0.5, "OVER").otherwise("UNDER"))


def json_text(doc, field: str) -> Column:
    """``doc ->> field`` with the empty string as null."""
    return F.nullif(F.get_json_object(c(doc), f"$.{field}"), F.lit(""))


def flag_text(x) -> Column:
    return F.lower(F.trim(c(x))).isin("1", "true", "yes", "y")
