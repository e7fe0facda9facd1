"""Query registry: one record wires a DataFrame plan, its output columns and, where SQL can say the same, an independent SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.market import Market


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Market], DataFrame]
    out: str
    sql: str | None

    def columns(self) -> list[tuple[str, str]]:
        return [tuple(p.split(":")) if ":" in p else (p, "d") for p in self.out.split()]

    def frame(self, spark: SparkSession, root: str) -> DataFrame:
        df = self.build(Market(spark, root))
        cols = []
        for n, t in self.columns():
            x = F.col(n)
            if t == "s":
                x = x.cast("string")
            elif t == "l":
                x = x.cast("long")
            elif t == "t":
                x = F.unix_timestamp(n)
            elif t[0] == "d":
                x = F.round(x.cast("double"), int(t[1:] or 6)) + F.lit(0.0)
            cols.append(x.alias(n))
        return df.select(*cols)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = []
        for n, t in self.columns():
            if t == "s":
                x = f"CAST({n} AS VARCHAR)"
            elif t == "l":
                x = f"CAST({n} AS BIGINT)"
            elif t == "t":
                x = f"CAST(floor(epoch({n})) AS BIGINT)"
            else:
                x = f"round(CAST({n} AS DOUBLE), {int(t[1:] or 6)}) + 0.0"
            cols.append(f"{x} AS {n}")
        ctes = prelude(self.sql)
        return "WITH " + ", ".join([*ctes, f"q AS ({self.sql})"]) + " SELECT " + ", ".join(cols) + " FROM q"


QUERIES: dict[str, Query] = {}
SHARED: dict[str, str] = {}


def shared(name: str, sql: str) -> None:
    """Name a CTE; it is added to an oracle text only when mentioned."""
    SHARED[name] = sql


def prelude(sql: str) -> list[str]:
    """Shared CTEs the text needs, dependencies first."""
    need: dict[str, str] = {}

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in SHARED and word not in need:
                need.setdefault(word, "")
                visit(SHARED[word])
                need.pop(word)
                need[word] = SHARED[word]

    visit(sql)
    return [f"{n} AS ({t})" for n, t in need.items()]


def query(name: str, out: str, sql: str | None = None):
    def add(build: Callable[[Market], DataFrame]):
        QUERIES[name] = Query(name, build, out, sql)
        return build
    return add


# ---- SQL text helpers -------------------------------------------------------------------------------------------------------
S = "PARTITION BY symbol ORDER BY bar_idx"


def over(n: int, shift: int = 0, s: str = S) -> str:
    return f"OVER ({s} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"


def s_agg(fn: str, x: str, n: int, shift: int = 0, s: str = S) -> str:
    return f"CASE WHEN count({x}) {over(n, shift, s)} = {n} THEN {fn}({x}) {over(n, shift, s)} END"


def s_mean(x, n, shift=0, s=S):
    return s_agg("avg", x, n, shift, s)


def s_std(x, n, shift=0, s=S):
    o = over(n, shift, s)
    return f"CASE WHEN count({x}) {o} = {n} THEN CASE WHEN min({x}) {o} = max({x}) {o} THEN 0.0 ELSE stddev_samp({x}) {o} END END"


def s_max(x, n, shift=0, s=S):
    return s_agg("max", x, n, shift, s)


def s_min(x, n, shift=0, s=S):
    return s_agg("min", x, n, shift, s)


def s_sum(x, n, shift=0, s=S):
    return s_agg("sum", x, n, shift, s)


def s_lag(x, k=1, s=S):
    return f"lag({x}, {k}) OVER ({s})"


def s_lead(x, k=1, s=S):
    return f"lead({x}, {k}) OVER ({s})"


def s_div(a, b, fill=None):
    t = f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END"
    return t if fill is None else f"coalesce({t}, {fill})"


def s_last(x, s=S, strict=False):
    return f"last_value({x} IGNORE NULLS) OVER ({s} ROWS BETWEEN UNBOUNDED PRECEDING AND {'1 PRECEDING' if strict else 'CURRENT ROW'})"


def s_since(cond, s=S):
    return f"bar_idx - {s_last(f'CASE WHEN {cond} THEN bar_idx END', s)}"


def s_flag(cond):
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def s_ewm(x, alpha: float, s=S, min_periods: int = 1):
    """Recursive mean seeded with the first value."""
    lst = f"list_filter(list({x}) OVER ({s} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda z: z IS NOT NULL)"
    body = f"list_reduce({lst}, lambda a, v: a + {alpha!r}::DOUBLE * (v - a))"
    return f"CASE WHEN count({x}) OVER ({s} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= {min_periods} THEN {body} END"


TR = f"greatest(high - low, abs(high - {s_lag('close')}), abs(low - {s_lag('close')}))"

shared("ticks", "SELECT event_type AS symbol, event_id AS seq, ts, value AS price, user_id FROM events")
shared("bars_raw", """SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, (ts, seq)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2""")
shared("bars", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM bars_raw")
shared("fine_raw", """SELECT symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high,
 min(price) AS low, arg_max(price, (ts, seq)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2""")
shared("fine", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM fine_raw")
shared("cbars_raw", """SELECT symbol, 'C' || (user_id % 3) AS contract_id, date_trunc('hour', ts) AS ts, arg_min(price, (ts, seq)) AS open,
 max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2, 3""")
shared("cbars", "SELECT *, row_number() OVER (PARTITION BY symbol, contract_id ORDER BY ts) - 1 AS bar_idx FROM cbars_raw")
shared("li_ticks", """SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, floor(l_extendedprice / l_quantity * 100) / 100 AS price,
 l_orderkey, l_linenumber, l_quantity FROM lineitem""")
shared("daily_raw", """SELECT symbol, date_trunc('day', ts) AS ts, arg_min(price, (l_orderkey, l_linenumber)) AS open, max(price) AS high,
 min(price) AS low, arg_max(price, (l_orderkey, l_linenumber)) AS close, sum(l_quantity) AS volume FROM li_ticks GROUP BY 1, 2""")
shared("daily", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM daily_raw")
