"""Rule tables for the typed layers: what each column of a source becomes, applied by one projection.

A rule reads ``kind`` or ``kind:arg:arg``, optionally after ``source > `` where the column is made from one
of another name.  `coded` turns a table of codes into labels.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxgrid.functions.columns import flag_to_int, normalize_id, normalize_string, yn_to_bool


def _yes(c: Column) -> Column:
    return F.upper(F.trim(c)) == "Y"


KINDS = {
    "trim": F.trim,
    "plain": lambda c: F.trim(c.cast("string")),
    "text": normalize_string,
    "id": lambda c, width: normalize_id(c, int(width)),
    "int": lambda c: c.cast("int"),
    "double": lambda c: c.cast("double"),
    "decimal": lambda c, p, s: c.cast(f"decimal({p},{s})"),
    # text that may not be a number becomes null
    "number": lambda c: F.trim(c).try_cast("double"),
    "code": lambda c: F.nullif(F.trim(c), F.lit("")).try_cast("int"),
    "amount": lambda c, p, s: F.trim(c.cast("string")).try_cast(f"decimal({p},{s})"),
    "digits": lambda c, p, s: F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast(f"decimal({p},{s})"),
    # through 6 places first, so that a double on a rounding boundary lands the same way in every engine
    "price": lambda c, p, s: c.cast("decimal(24,6)").cast(f"decimal({p},{s})"),
    "yes": _yes,
    "yes01": lambda c: _yes(c).cast("int"),
    "yn": yn_to_bool,
    "bit": flag_to_int,
    "null": lambda c: c.isNull(),
    "given": lambda c: c.isNotNull(),
}


def applied(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """`df` with the columns of a rule table, all from the columns as they came."""
    out = {}
    for name, rule in rules.items():
        source, _, rest = rule.rpartition(" > ")
        kind, *args = rest.split(":")
        out[name] = KINDS[kind](F.col(source or name), *args)
    return df.withColumns(out)


def coded(c: Column, labels: Mapping[int, str], other: str | None = None) -> Column:
    """The label of a code (`other` for codes and nulls without one)."""
    out = F.lit(other)
    for code, text in labels.items():
        out = F.when(c == code, F.lit(text)).otherwise(out)
    return out


def joined(sep: str, *cols: str) -> Column:
    """A key of several columns as text."""
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in cols])


def total(cols: list[str], missing: int | None = None) -> Column:
    """Sum of columns; `missing` stands for a null (None: the sum is null)."""
    parts = [F.col(c) if missing is None else F.coalesce(F.col(c), F.lit(missing)) for c in cols]
    return sum(parts[1:], parts[0])
