"""DuckDB SQL fragments mirroring ``upkeep.functions.columns`` (oracle side)."""

from __future__ import annotations

from upkeep.functions.columns import NUMBER_PATTERN

# Spark datetime patterns → strptime formats (same order as schema.DATE_FORMATS)
STRPTIME_FORMATS = [
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M",
    "%Y-%m-%d",
    "%Y/%m/%d %H:%M:%S",
    "%Y/%m/%d",
    "%m/%d/%Y",
    "%d.%m.%Y",
]


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def clean_text(x: str) -> str:
    return f"CASE WHEN {strip(x)} IN ('', 'nan', 'None') THEN NULL ELSE {strip(x)} END"


def to_double(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NUMBER_PATTERN}') THEN TRY_CAST({strip(x)} AS DOUBLE) END"


def parse_ts(x: str) -> str:
    s = strip(x)
    return "coalesce(" + ", ".join(f"try_strptime({s}, '{f}')" for f in STRPTIME_FORMATS) + ")"


def r6d(x: str) -> str:
    return f"CAST(round(TRY_CAST({x} AS DECIMAL(38,10)), 6) AS DOUBLE)"
