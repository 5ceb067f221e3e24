"""SQL text for the cross-engine checks: the same results written as plain SQL."""

from __future__ import annotations

from ..config import AlertConfig
from ..functions.linear import LinearModel

EVENTS = """ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST(event_type = 'error' AS BIGINT) AS failure
  FROM events)"""

LINES = """li AS (
  SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey,
         l_quantity, l_extendedprice, l_discount, l_tax,
         CAST(l_returnflag = 'R' AS BIGINT) AS returned,
         CAST(l_linestatus = 'F' AS BIGINT) AS closed,
         CAST(l_discount >= 0.05 AS BIGINT) AS discounted
  FROM lineitem)"""

DOCS = """docs AS (
  SELECT d.doc_id, d.n_chars / 1000.0 AS score,
         CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def rnd(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def features(source: str, keys: list[str], order: list[str], sensors: list[str], preset: str, name: str = "f") -> str:
    """CTEs `{name}_d` (deltas) and `{name}` (all features)."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    w = f"({part}ORDER BY {', '.join(order)}"
    full = f"{w} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    short = f"{w} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
    deltas = ", ".join(f'{s} - lag({s}) OVER {w}) AS "d_{s}"' for s in sensors)
    out = []
    for s in sensors:
        if preset == "train":
            out += [
                f'CASE WHEN count({s}) OVER {full} = 5 THEN avg({s}) OVER {full} END AS "{s}_Rolling_Mean"',
                f'CASE WHEN count({s}) OVER {full} = 5 THEN stddev_samp({s}) OVER {full} END AS "{s}_Volatility"',
                f'"d_{s}" AS "{s}_Delta"',
                f'CASE WHEN count("d_{s}") OVER {full} = 5 THEN avg("d_{s}") OVER {full} END AS "{s}_Rolling_Delta"',
            ]
        else:
            out += [
                f'coalesce(avg({s}) OVER {full}, 0) AS "{s}_Rolling_Mean"',
                f'coalesce(stddev_samp({s}) OVER {full}, 0) AS "{s}_Volatility"',
                f'coalesce("d_{s}", 0) AS "{s}_Delta"',
                f'coalesce(avg("d_{s}") OVER {short}, 0) AS "{s}_Rolling_Delta"',
            ]
    return f"""{name}_d AS (SELECT *, {deltas} FROM {source}),
{name} AS (SELECT *, {', '.join(out)} FROM {name}_d)"""


def probability(model: LinearModel) -> str:
    terms = [repr(model.intercept)] + [
        f'{b!r}::DOUBLE * ("{n}" - {m!r}::DOUBLE) / {s!r}::DOUBLE'
        for n, b, m, s in zip(model.features, model.coefficients, model.centers, model.scales)
        if b != 0.0
    ]
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({' + '.join(terms)}))))"


def smooth(source: str, config: AlertConfig, keys: str = "user_id", order: str = "ts, event_id", name: str = "sm") -> str:
    back = config.smoothing_rows - 1
    return f"""{name} AS (SELECT *, avg(risk) OVER (PARTITION BY {keys} ORDER BY {order}
    ROWS BETWEEN {back} PRECEDING AND CURRENT ROW) AS smooth FROM {source})"""


def streak(source: str, config: AlertConfig, keys: str = "user_id", order: str = "ts, event_id", name: str = "st",
           zone: str | None = None) -> str:
    """Gaps-and-islands form of the streak; `keys` may hold a parameter column."""
    t, p = f"{config.critical_threshold!r}::DOUBLE", config.persistence
    zone = zone or f"{config.warning_zone!r}::DOUBLE"
    ov = f"{config.override_level!r}::DOUBLE"
    w = f"(PARTITION BY {keys} ORDER BY {order})"
    return f"""{name}_1 AS (SELECT *, row_number() OVER {w} AS step,
    sum(CASE WHEN smooth < {zone} THEN 1 ELSE 0 END) OVER {w} AS island FROM {source}),
{name}_2 AS (SELECT *,
    coalesce(max(CASE WHEN smooth < {zone} THEN step END) OVER {w}, 0) AS reset_at,
    min(CASE WHEN smooth < {t} AND smooth >= {ov} THEN step END)
      OVER (PARTITION BY {keys}, island ORDER BY {order}) AS lift_at FROM {name}_1),
{name} AS (SELECT *, CAST(greatest(step - reset_at, coalesce({p} + step - lift_at, 0)) AS BIGINT) AS streak
  FROM {name}_2)"""


def level(config: AlertConfig, zone: str | None = None) -> str:
    zone = zone or f"{config.warning_zone!r}::DOUBLE"
    return f"""CASE WHEN smooth >= {config.critical_threshold!r}::DOUBLE THEN 'CRITICAL'
    WHEN smooth >= {config.override_level!r}::DOUBLE THEN 'WARNING'
    WHEN smooth >= {zone} AND streak >= {config.persistence} THEN 'WARNING' ELSE 'HEALTHY' END"""
