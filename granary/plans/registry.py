"""Query registry and the SQL building blocks shared by the equivalent texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.scalars import round_half_up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIGITS = 4


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Reports round every double column; the operators themselves never round."""
    return df.select(*[
        round_half_up(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(key: str, sql: str | None = None, digits: int = DIGITS):
    """Register a (spark, folder) -> DataFrame function with its SQL text."""
    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, folder: rounded(fn(spark, folder), digits)
        if sql is not None:
            SQL[key] = expand(sql, digits)
        return fn
    return wrap


_ROUND = re.compile(r"^(\s*)~(.*?) AS (\w+)(,?)\s*$", re.M)


def expand(sql: str, digits: int = DIGITS) -> str:
    """A line ``~expr AS name`` becomes the rounded expression; ``@name@`` pulls in a base table."""
    scale = f"1e{digits}"
    sql = _ROUND.sub(lambda m: f"{m[1]}floor(({m[2]}) * {scale} + 0.5) / {scale} AS {m[3]}{m[4]}", sql)
    needed: list[str] = []

    def visit(text):
        for name in re.findall(r"@(\w+)@", text):
            if name not in needed:
                visit(BASE[name])
                needed.append(name)
    visit(sql)
    body = re.sub(r"@(\w+)@", r"\1", sql).strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({re.sub(r'@(\w+)@', r'\1', BASE[n]).strip()})" for n in needed)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:].lstrip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:].lstrip()}"
    return f"WITH {ctes}\n{body}"


SER = "commodity, market, variety"
W = f"(PARTITION BY {SER} ORDER BY reported_date)"


def rows(lo: int, hi: int, part: str = SER, order: str = "reported_date") -> str:
    """SQL frame between row offsets (negative is preceding)."""
    side = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {side(lo)} AND {side(hi)})"


def days(lo: int, hi: int, part: str = SER, order: str = "reported_date") -> str:
    """SQL frame between day offsets."""
    side = lambda k: ("CURRENT ROW" if k == 0 else
                      f"INTERVAL {abs(k)} DAYS {'PRECEDING' if k < 0 else 'FOLLOWING'}")
    return f"(PARTITION BY {part} ORDER BY {order} RANGE BETWEEN {side(lo)} AND {side(hi)})"


def strict(agg: str, col: str, n: int, lo: int, hi: int, **kw) -> str:
    """Aggregate over a frame that must hold n values."""
    f = rows(lo, hi, **kw)
    return f"CASE WHEN count({col}) OVER {f} = {n} THEN {agg}({col}) OVER {f} END"


def lag(col: str, k: int = 1, part: str = SER, order: str = "reported_date") -> str:
    return f"lag({col}, {k}) OVER (PARTITION BY {part} ORDER BY {order})"


# Every spelling that the raw table holds; two-digit years before four-digit ones, which would read them too.
DAY_SQL = """CAST(coalesce(%s) AS DATE)""" % ", ".join(f"try_strptime(reported_date, '{f}')" for f in (
    "%d %b %Y", "%Y-%m-%d", "%d/%m/%y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d",
    "%d-%b-%Y", "%d %B %Y", "%b %d, %Y"))

BASE: dict[str, str] = {
    "lines": """
        SELECT l.*, n_name, n_regionkey, n_nationkey,
          floor(l_extendedprice / l_quantity + 0.5) AS price, CAST(l_shipdate AS DATE) AS day
        FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "obs": """
        SELECT 'rice' AS commodity, n_name AS market, l_returnflag AS variety, day AS reported_date,
          min(price) AS min_price, max(price) AS max_price,
          quantile_cont(price, 0.5) AS modal_price, sum(l_quantity) AS arrivals
        FROM @lines@ GROUP BY ALL""",
    "obs_raw": """
        SELECT 'rice' AS commodity, 'REGION_' || n_regionkey AS state, n_name AS district,
          CASE WHEN m = 15 THEN lower(n_name) WHEN m = 16 THEN '  ' || n_name || ' '
               WHEN m = 17 THEN 'Haat ' || n_nationkey ELSE n_name END AS market,
          l_returnflag AS variety,
          CASE WHEN l_linestatus = 'F' THEN ' Cereals' ELSE 'PULSES' END AS "group",
          CASE WHEN m = 18 THEN NULL WHEN m = 19 THEN '-4' WHEN m = 21 THEN 'nan'
               WHEN m = 22 THEN '1e999' WHEN m = 23 THEN '125e-002'
               ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS arrivals,
          CASE WHEN m = 11 THEN '0' WHEN m = 13 THEN hi ELSE lo END AS min_price,
          CASE WHEN m = 12 THEN '0' WHEN m = 13 THEN lo ELSE hi END AS max_price,
          CASE WHEN m = 7 THEN 'N/A' WHEN m = 8 THEN '0' WHEN m = 9 THEN '-5'
               WHEN m = 14 THEN CAST(CAST(hi AS BIGINT) + 1 AS VARCHAR)
               ELSE CAST(CAST(price AS BIGINT) AS VARCHAR) END AS modal_price,
          CASE WHEN m = 3 THEN 'not a date' WHEN m = 25 THEN strftime(day, '%Y-02-31')
               WHEN m = 20 THEN strftime(day, '%Y-%m-%d 00:00:00') WHEN m = 24 THEN strftime(day, '%Y-%m-%dT00:00:00')
               WHEN m = 28 THEN strftime(day, '%Y-%-m-%-d') WHEN m = 32 THEN strftime(day, '%Y/%m/%d')
               WHEN m = 36 THEN strftime(day, '%d-%b-%Y') WHEN m = 40 THEN strftime(day, '%-d %B %Y')
               WHEN m = 44 THEN strftime(day, '%b %-d, %Y') WHEN m = 48 THEN strftime(day, '%d/%m/%y')
               WHEN m % 4 = 1 THEN strftime(day, '%d %b %Y')
               WHEN m % 4 = 2 THEN strftime(day, '%d/%m/%Y') ELSE strftime(day, '%Y-%m-%d') END AS reported_date
        FROM (SELECT *, l_partkey % 50 AS m,
                CAST(CAST(price AS BIGINT) - l_linenumber * 2 AS VARCHAR) AS lo,
                CAST(CAST(price AS BIGINT) + l_linenumber * 3 AS VARCHAR) AS hi FROM @lines@)""",
    "typed": """
        SELECT commodity, state, district, market, variety, "group",
          CASE WHEN isfinite(TRY_CAST(arrivals AS DOUBLE)) THEN TRY_CAST(arrivals AS DOUBLE) END AS arrivals,
          TRY_CAST(min_price AS DOUBLE) AS min_price, TRY_CAST(max_price AS DOUBLE) AS max_price,
          TRY_CAST(modal_price AS DOUBLE) AS modal_price,
          @@DAY@@ AS reported_date
        FROM @obs_raw@""",
    "nation_orders": """
        SELECT n_name AS district, CAST(o_orderdate AS DATE) AS date, floor(o_totalprice + 0.5) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "panel": """
        SELECT *, production / area * 1000 AS yield_kg_ha FROM (
          SELECT district, CASE WHEN month(date) <= 4 THEN 'Summer' WHEN month(date) <= 8 THEN 'Autumn'
                                ELSE 'Winter' END AS season, CAST(year(date) AS INTEGER) AS year,
            CAST(count(*) AS DOUBLE) AS area, sum(total) / 1000 AS production
          FROM @nation_orders@ GROUP BY ALL)""",
    "weather": """
        SELECT district, date, CASE WHEN miss THEN -999.0::DOUBLE ELSE n::DOUBLE END AS precip,
          CASE WHEN miss THEN -999.0::DOUBLE ELSE med / 8192 END AS t2m,
          CASE WHEN miss THEN -999.0::DOUBLE ELSE lo / 8192 END AS t2m_min,
          CASE WHEN miss THEN -999.0::DOUBLE ELSE hi / 8192 END AS t2m_max,
          CASE WHEN miss THEN -999.0::DOUBLE ELSE (n % 101)::DOUBLE END AS rh2m,
          CASE WHEN miss THEN -999.0::DOUBLE ELSE dayofyear(date)::DOUBLE / 8 END AS solar,
          CASE WHEN miss THEN -999.0::DOUBLE ELSE (epoch_day % 7)::DOUBLE END AS wind
        FROM (SELECT district, date, (date - DATE '1970-01-01') AS epoch_day,
                (date - DATE '1970-01-01') % 97 = 0 AS miss, count(*) AS n,
                quantile_cont(total, 0.5) AS med, min(total) AS lo, max(total) AS hi
              FROM @nation_orders@ GROUP BY district, date)""",
    "ledger": """
        SELECT substr(sha256(lower(market) || '|' || lower(variety) || '|' || strftime(origin_date, '%Y-%m-%d')
                 || '|' || horizon || '|persistence'), 1, 16) AS forecast_id,
          commodity, market, variety, origin_date, horizon, origin_price, origin_price AS predicted_price,
          CAST(origin_date + horizon AS DATE) AS window_start, CAST(origin_date + horizon + 3 AS DATE) AS window_end,
          CASE WHEN year(origin_date) < 2000 THEN 'RETROSPECTIVE' ELSE 'PROSPECTIVE' END AS cohort,
          'PENDING' AS status
        FROM (SELECT commodity, market, variety, reported_date AS origin_date, modal_price AS origin_price,
                unnest([14, 30]) AS horizon
              FROM (SELECT *, row_number() OVER (PARTITION BY commodity, market, variety
                                                 ORDER BY reported_date) AS rn FROM @obs@)
              WHERE rn % 30 = 0)""",
}
BASE["typed"] = BASE["typed"].replace("@@DAY@@", DAY_SQL)
