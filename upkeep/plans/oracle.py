"""DuckDB oracle texts for the bindings (the same definitions as
``upkeep.sources.testdata`` and ``upkeep.plans.serving_data``), composed as
CTEs in front of each oracle query."""

from __future__ import annotations

CTE: dict[str, str] = {}

CTE["asset_snapshot"] = """
SELECT c.c_custkey AS machine_id,
       c.c_mktsegment AS equipment_category,
       CASE WHEN c.c_nationkey % 5 = 0 THEN NULL
            ELSE 'MFR_' || CAST(c.c_nationkey AS VARCHAR) END AS manufacturer,
       CASE WHEN c.c_acctbal >= 7000 THEN 'High'
            WHEN c.c_acctbal >= 3000 THEN 'Medium' ELSE 'Low' END AS criticality,
       o.overdue_pms, o.overdue_wos, o.total_completed_pms, o.total_completed_wos,
       o.downtime_minutes, c.c_acctbal AS total_cost,
       o.last_completed_pm, o.last_completed_wo
FROM customer c LEFT JOIN (
  SELECT o_custkey,
    CAST(SUM(CASE WHEN o_orderstatus='O' AND o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS overdue_pms,
    CAST(SUM(CASE WHEN o_orderstatus='O' AND o_orderpriority NOT IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS overdue_wos,
    CAST(SUM(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS BIGINT) AS total_completed_pms,
    CAST(SUM(CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END) AS BIGINT) AS total_completed_wos,
    CAST(SUM(CASE WHEN o_orderstatus='O' THEN CAST(FLOOR(o_totalprice/1000) AS BIGINT) ELSE 0 END) AS DOUBLE) AS downtime_minutes,
    MAX(CASE WHEN o_orderstatus='F' THEN o_orderdate END) AS last_completed_pm,
    MAX(CASE WHEN o_orderstatus='P' THEN o_orderdate END) AS last_completed_wo
  FROM orders GROUP BY o_custkey
) o ON o.o_custkey = c.c_custkey
"""

CTE["telemetry"] = """
SELECT event_id, user_id AS machine_id, ts AS "timestamp", value AS vibration,
       CASE WHEN event_type='error' THEN NULL ELSE value * 0.5 END AS pressure,
       CASE WHEN event_type='purchase' THEN 1 ELSE 0 END AS failure_label
FROM events
"""

CTE["raw_rows"] = """
SELECT machine_id AS _k,
  CASE WHEN machine_id % 3 = 0 THEN '  ' || CAST(machine_id AS VARCHAR) || ' '
       WHEN machine_id % 3 = 1 THEN chr(9) || CAST(machine_id AS VARCHAR)
       ELSE CAST(machine_id AS VARCHAR) END AS "Asset ID",
  CASE WHEN machine_id % 13 = 0 THEN '' ELSE equipment_category END AS "Equipment Category",
  CASE WHEN machine_id % 7 = 1 THEN '' WHEN machine_id % 7 = 2 THEN 'None'
       WHEN machine_id % 7 = 3 THEN 'nan' WHEN machine_id % 5 = 4 THEN manufacturer || ' '
       ELSE manufacturer END AS "Manufacturer",
  criticality AS "Criticality",
  CAST(overdue_pms AS VARCHAR) AS "Overdue PMs",
  CASE WHEN machine_id % 17 = 0 THEN '5d' ELSE CAST(overdue_wos AS VARCHAR) END AS "Overdue WOs",
  CAST(total_completed_pms AS VARCHAR) AS "Total Completed PMs",
  CAST(total_completed_wos AS VARCHAR) AS "Total Completed WOs",
  CAST(CAST(downtime_minutes AS BIGINT) AS VARCHAR) AS "Downtime (min)",
  CAST(CAST(total_cost AS DECIMAL(12,2)) AS VARCHAR) AS "Total Cost",
  CASE WHEN machine_id % 2 = 0 THEN strftime(last_completed_pm, '%Y/%m/%d')
       ELSE strftime(last_completed_pm, '%Y-%m-%d') END AS "Last Completed PM",
  strftime(last_completed_wo, '%Y-%m-%d') AS "Last Completed WO",
  CASE WHEN machine_id % 11 = 0 THEN 'Not Applicable (area node)'
       ELSE CAST(machine_id % 97 AS VARCHAR) END AS "Global Anomaly Score",
  CASE WHEN machine_id % 2 = 0 THEN 'SN-' || CAST(machine_id AS VARCHAR)
       ELSE CAST(machine_id AS VARCHAR) END AS "Serial Number",
  CAST(machine_id % 23 AS VARCHAR) AS "Spare Parts Count",
  CASE WHEN machine_id % 4 = 0 THEN NULL ELSE 'note ' || CAST(machine_id % 4 AS VARCHAR) END AS "Irrelevant Notes"
FROM asset_snapshot
"""

CTE["raw_export"] = """
SELECT * EXCLUDE (_k) FROM raw_rows
UNION ALL
SELECT * EXCLUDE (_k) REPLACE (
  CASE WHEN _k % 20 = 10 THEN CAST(_k AS VARCHAR) || ' ' ELSE "Asset ID" END AS "Asset ID")
FROM raw_rows WHERE _k % 10 = 0
"""

# Dependencies between binding CTEs, so a query names only what it uses.
DEPS: dict[str, list[str]] = {
    "asset_snapshot": [],
    "telemetry": [],
    "raw_rows": ["asset_snapshot"],
    "raw_export": ["raw_rows"],
}


def register(name: str, sql: str, deps: list[str]) -> None:
    CTE[name] = sql
    DEPS[name] = deps


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in DEPS[n]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_ctes(uses: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the binding CTEs it uses (plus query-local CTEs)."""
    parts = [f"{n} AS ({CTE[n].strip()})" for n in _closure(uses)]
    parts += [f"{n} AS ({s.strip()})" for n, s in (extra or [])]
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
