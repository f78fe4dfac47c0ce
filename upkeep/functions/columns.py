"""Column-expression helpers. Everything here returns a ``Column`` built from
``pyspark.sql.functions`` so it stays inside whole-stage codegen."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.schema import DATE_FORMATS, NULL_TOKENS

# A number the way a pandas ``to_numeric`` accepts it: optional sign, digits
# with optional fraction (or a bare fraction), optional exponent. Spark's
# cast additionally accepts suffixes such as '5d' / '5f', which must be NULL.
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """Remove leading/trailing whitespace of any kind (``trim`` only drops spaces)."""
    return F.regexp_replace(F.regexp_replace(col_(c), r"^\s+", ""), r"\s+$", "")


def clean_text(c: str | Column) -> Column:
    """Strip, then map the null tokens to NULL (exact, case-sensitive)."""
    s = strip_ws(col_(c).cast("string"))
    return F.when(s.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(s)


def nan_to_null(c: str | Column) -> Column:
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(c: str | Column, dtype: str = "string", stripped: bool = False) -> Column:
    """Unparseable → NULL, NaN → NULL. ``dtype`` is the input column's type name."""
    c = col_(c)
    if dtype in ("double", "float", "bigint", "int", "smallint", "tinyint") or dtype.startswith("decimal"):
        return nan_to_null(c.cast("double"))
    if dtype == "boolean":
        return c.cast("int").cast("double")
    s = c.cast("string")
    parsed = F.when(s.rlike(NUMBER_PATTERN), (s if stripped else strip_ws(s)).try_cast("double"))
    return nan_to_null(parsed)


def format_guard(fmt: str) -> str:
    """A permissive regex of a datetime pattern's shape (letter runs → digits,
    quoted text and separators literal). Values that cannot match skip the
    parse attempt, which is expensive when it fails."""
    out, i = ["^"], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "'":
            j = fmt.index("'", i + 1)
            out.append(re.escape(fmt[i + 1:j]))
            i = j + 1
        elif ch.isalpha():
            j = i
            while j < len(fmt) and fmt[j] == ch:
                j += 1
            if ch == "X":
                out.append(r"(?:Z|[+-]\d\d:\d\d)")
            elif ch == "M" and j - i > 2:
                out.append("[A-Za-z]+")
            else:
                out.append(r"\d+")
            i = j
        else:
            out.append(re.escape(ch))
            i += 1
    out.append("$")
    return "".join(out)


def parse_timestamp(c: str | Column, dtype: str = "string", formats: Iterable[str] = DATE_FORMATS,
                    stripped: bool = False) -> Column:
    """Mixed-format date parsing: each value takes the first format that fits.
    ``stripped``: the input is already whitespace-stripped (strip once in a
    projection below, instead of once per format attempt)."""
    c = col_(c)
    if dtype in ("timestamp_ntz",):
        return c
    if dtype in ("timestamp", "date"):
        return c.cast("timestamp_ntz")
    s = c.cast("string") if stripped else strip_ws(c.cast("string"))
    tries = [F.when(s.rlike(format_guard(fmt)), F.try_to_timestamp(s, F.lit(fmt))) for fmt in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


# Shapes of mixed dates: a date in front, a time of day behind it (or nothing). Each
# shape is rewritten as year-month-day by the places of its three groups.
_TIME = r"(?:[ T]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?\s*(?:Z|[+-]\d{2}:?\d{2})?)?$"
_DATE_SHAPES = [
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "$1-$2-$3"),
    (r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3"),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2"),
    (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", "$3-$2-$1"),
    (r"([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})", "$3-$1-$2"),
    (r"(\d{1,2})[ -]([A-Za-z]{3,9})\.?[ ,-]\s*(\d{4})", "$3-$2-$1"),
]
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def parse_mixed(c: str | Column, stripped: bool = False) -> Column:
    """Dates in mixed spellings, one rule per shape: year, month and day in the order
    of the shape, month names in full or in three letters, an optional time of day
    with fraction (to the microsecond) and offset (the result is then in UTC). What
    has no shape, or is no date of the calendar, is NULL; ``date_failures`` counts it."""
    s = col_(c).cast("string")
    s = s if stripped else strip_ws(s)
    plain = s
    for shape, order in _DATE_SHAPES[1:]:
        plain = F.regexp_replace(plain, rf"^{shape}(?={_TIME})", order)
    plain = F.regexp_replace(plain, r"^(\d{4})[/.](\d{1,2})[/.]", "$1-$2-")
    for i, name in enumerate(_MONTHS):
        plain = F.regexp_replace(plain, rf"(?i)^(\d{{4}})-(?:{name}|{name[:3]})-", f"$1-{i + 1}-")
    plain = F.regexp_replace(plain, r"(:\d{2}(?:\.\d+)?)\s*([+-]\d{2}):?(\d{2})$", "$1$2:$3")
    known = s.rlike("^(?:" + "|".join(shape for shape, _ in _DATE_SHAPES) + ")" + _TIME)
    return F.when(known, plain.try_cast("timestamp").cast("timestamp_ntz"))


def date_mask(c: str | Column) -> Column:
    """A text's shape: digits as 9, letters as a, runs of letters as one."""
    return F.regexp_replace(F.regexp_replace(strip_ws(col_(c).cast("string")), r"[0-9]", "9"), r"\p{L}+", "a")


def date_failures(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mask, n, example) of the texts that are no dates, by shape; the
    counts are combined map-side, so a frequent shape is one row."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("r")
    long = df.select(cells).select("r.*").where(F.trim("v") != "").where(parse_mixed("v").isNull())
    return long.groupBy("column_name", date_mask("v").alias("mask")).agg(F.count("*").alias("n"), F.min("v").alias("example"))


def micros(ts: str | Column) -> Column:
    """Long time axis (µs since epoch) for range frames on timestamp_ntz."""
    return F.unix_micros(col_(ts).cast("timestamp"))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def r6(c: Column) -> Column:
    """Round to 6 decimals for stable comparison of double results."""
    return F.round(c, 6)


def r6d(c: Column) -> Column:
    """Round to 6 decimals through DECIMAL(38,10): float noise in the last bits
    (summation order) cannot flip a value that sits exactly on a tie."""
    return F.round(c.try_cast("decimal(38,10)"), 6).cast("double")


def md5_order(seed: int, key: str | Column) -> Column:
    """Deterministic pseudo-random order key: md5('<seed>:<key>')."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col_(key).cast("string")))


def stable_key(*parts: str | Column) -> Column:
    """Deterministic 64-bit surrogate key from business columns (xxhash64)."""
    return F.xxhash64(*[col_(p) for p in parts])
