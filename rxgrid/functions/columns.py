"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColOrName = Column | str


def col(c: ColOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_ndc(c: ColOrName) -> Column:
    """NDC as join key: trimmed, dashes and blanks removed."""
    return F.replace(F.replace(F.trim(col(c).cast("string")), F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))


def blank_to_null(c: ColOrName) -> Column:
    """``NULLIF(TRIM(x), '')`` on the text form."""
    t = F.trim(col(c).cast("string"))
    return F.when(t != "", t)


def try_int(c: ColOrName) -> Column:
    """Lenient integer cast (``TRY_CAST`` semantics, text may hold ``3.0``)."""
    s = F.trim(col(c).cast("string"))
    return F.coalesce(s.try_cast("int"), s.try_cast("double").try_cast("int"))


def try_double(c: ColOrName) -> Column:
    return F.trim(col(c).cast("string")).try_cast("double")


def days_supply_code(days: ColOrName) -> Column:
    """Days supply bucket -> CMS code: >=75 -> 2 (90d), >=45 -> 4 (60d), else 1 (30d)."""
    d = col(days)
    return F.when(d >= 75, 2).when(d >= 45, 4).otherwise(1)


def days_supply_months(days: ColOrName) -> Column:
    d = col(days)
    return F.when(d >= 75, 3.0).when(d >= 45, 2.0).otherwise(1.0)


def days_supply_units(days: ColOrName) -> Column:
    d = col(days)
    return F.when(d >= 75, 90.0).when(d >= 45, 60.0).otherwise(30.0)


def yn_to_bool(c: ColOrName) -> Column:
    """Y/N text -> nullable boolean."""
    u = F.upper(F.trim(col(c).cast("string")))
    return F.when(u == "Y", F.lit(True)).when(u == "N", F.lit(False))


def flag_to_int(c: ColOrName) -> Column:
    """Flag text -> 0/1: Y/YES/T/TRUE/1 -> 1, N/NO/F/FALSE/0 -> 0, else lenient int cast."""
    u = F.upper(F.trim(col(c).cast("string")))
    return (
        F.when(u.isin("Y", "YES", "T", "TRUE", "1"), F.lit(1))
        .when(u.isin("N", "NO", "F", "FALSE", "0"), F.lit(0))
        .otherwise(u.try_cast("int"))
    )


def yn_flag(c: ColOrName) -> Column:
    """1 when the flag text is Y, else 0."""
    return F.when(F.upper(F.trim(col(c).cast("string"))) == "Y", 1).otherwise(0)


def normalize_id(c: ColOrName, pad: int) -> Column:
    """Trimmed upper-case id left-padded with zeros; lpad also truncates."""
    return F.lpad(F.upper(F.trim(col(c).cast("string"))), pad, "0")


def normalize_string(c: ColOrName) -> Column:
    return F.upper(F.trim(col(c).cast("string")))


def county_code5(c: ColOrName) -> Column:
    """Numeric county text (also ``1001.0``) -> 5 digits; blank or junk -> '' (B29)."""
    v = F.trim(col(c).cast("string"))
    n = v.try_cast("double").cast("bigint")
    return F.when(v.isNull() | (v == ""), F.lit("")).when(n.isNull(), F.lit("")).when(
        F.length(n.cast("string")) > 5, n.cast("string")
    ).otherwise(F.lpad(n.cast("string"), 5, "0"))


def contract_type(is_ma_pd: ColOrName, is_pdp: ColOrName, other: str | None = None) -> Column:
    """MA / PDP from plan flags (B30); ``other`` for neither (None or 'Other')."""
    return F.when(col(is_ma_pd), "MA").when(col(is_pdp), "PDP").otherwise(F.lit(other))


def safe_div(a: ColOrName, b: ColOrName) -> Column:
    return F.try_divide(col(a), col(b))
