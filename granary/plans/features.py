"""Series features and feature sets."""

from pyspark.sql import functions as F

from granary.operators import features as T
from granary.plans.registry import days, lag, query, rows, strict
from granary.sources import adapters as A

KEY = ("market", "variety", "reported_date")
P, ARR = "modal_price", "arrivals"
E4, E5 = "0.0001::DOUBLE", "0.00001::DOUBLE"


def obs(spark, folder):
    return A.observations(spark, folder)


def pick(df, *groups):
    names = [n for g in groups for n in g]
    return df.select(*KEY, *names)


def feature_sql(columns, base: str = "FROM @obs@", with_: str = ""):
    """SELECT over the key and rounded (name, expression) pairs."""
    lines = ",\n".join(f"  ~{e} AS {n}" if not n.startswith("#") else f"  {e} AS {n[1:]}" for n, e in columns)
    return f"{with_}\nSELECT {', '.join(KEY)},\n{lines}\n{base}"


def lags(ks, col=P, prefix="lag"):
    return [(f"{prefix}_{k}", lag(col, k)) for k in ks]


def means(ns, col=P, prefix="rolling_mean"):
    return [(f"{prefix}_{n}", strict("avg", col, n, -n, -1)) for n in ns]


def stds(ns, col=P, prefix="rolling_std", incl=False, zero=True):
    out = []
    for n in ns:
        e = strict("stddev_samp", col, n, -(n - 1) if incl else -n, 0 if incl else -1)
        out.append((f"{prefix}_{n}", f"coalesce({e}, 0)" if zero else e))
    return out


def medians(ns, incl):
    out = []
    for n in ns:
        f = rows(-(n - 1) if incl else -n, 0 if incl else -1)
        out.append((f"rolling_median_{n}", f"CASE WHEN count({P}) OVER {f} = {n} THEN quantile_cont({P}, 0.5) OVER {f} END"))
    return out


def slopes(ns):
    # least squares over the row number; the frame must be full
    out = []
    for n in ns:
        f = rows(-(n - 1), 0)
        out.append((f"trend_slope_{n}", f"CASE WHEN count({P}) OVER {f} = {n} THEN regr_slope({P}, rn) OVER {f} END"))
    return out


CAL = {"year": "year(reported_date)", "day": "day(reported_date)", "month": "month(reported_date)",
       "day_of_week": "isodow(reported_date) - 1", "week_of_year": "weekofyear(reported_date)",
       "quarter": "quarter(reported_date)"}


def cal(*names):
    return [(f"#{n}", f"CAST({CAL[n]} AS INTEGER)") for n in names]


def pct(col, name):
    before = lag(col)
    return (name, f"CASE WHEN {before} = 0 AND {col} <> 0 THEN 0 ELSE ({col} - {before}) / nullif({before}, 0) * 100 END")


NUMBERED = f"n AS (SELECT *, row_number() OVER (PARTITION BY commodity, market, variety ORDER BY reported_date) AS rn FROM @obs@)"


@query("d01_lag_features", feature_sql(lags((1, 2, 3, 5, 7, 10, 14, 21, 30))))
def d01(spark, folder):
    f = T.lag_features((1, 2, 3, 5, 7, 10, 14, 21, 30))
    return pick(T.add(obs(spark, folder), f), f)


@query("d02_rolling_past", feature_sql(means((3, 5, 7, 14, 30)) + stds((5, 7, 14, 30))))
def d02(spark, folder):
    m, s = T.rolling_mean((3, 5, 7, 14, 30)), T.or_zero(T.rolling_std((5, 7, 14, 30)))
    return pick(T.add(obs(spark, folder), m, s), m, s)


@query("d03_rolling_order_stats", feature_sql(
    medians((7, 14), False) + [("rolling_min_7", strict("min", P, 7, -7, -1)), ("rolling_max_7", strict("max", P, 7, -7, -1))]
    + [(n.replace("median", "median_incl"), e) for n, e in medians((7, 14, 30), True)]))
def d03(spark, folder):
    past_, mm = T.rolling_median((7, 14)), T.rolling_min_max(7)
    incl = {n.replace("median", "median_incl"): c for n, c in T.rolling_median((7, 14, 30), frame=T.trailing).items()}
    return pick(T.add(obs(spark, folder), past_, mm, incl), past_, mm, incl)


def _changes(ks):
    return ", ".join(f"{P} - lag_{k} AS price_change_{k}" for k in ks)


LAGGED = ("l AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in lags((1, 3, 7, 14)))
          + " FROM @obs@),\nc AS (SELECT *, " + _changes((1, 3, 7, 14)) + " FROM l)")
MOMENTUM = [(f"momentum_{k}", f"price_change_{k} / (lag_{k} + {E4}) * 100") for k in (3, 7, 14)]
ACCEL = [("acceleration_3_7", "price_change_3 - (price_change_7 - price_change_3)"),
         ("acceleration_7_14", "price_change_7 - (price_change_14 - price_change_7)"),
         ("accel_1_7", "price_change_1 - price_change_7 / 7"), ("accel_1_14", "price_change_1 - price_change_14 / 14")]


@query("d04_differences_momentum", feature_sql(
    [(f"price_change_{k}", f"price_change_{k}") for k in (1, 3, 7, 14)] + MOMENTUM + ACCEL
    + [("plain_accel_1_7", "price_change_1 - price_change_7"), ("plain_accel_1_14", "price_change_1 - price_change_14")],
    "FROM c", f"WITH {LAGGED}"))
def d04(spark, folder):
    d, m, a = T.differences(), T.momentum(), T.accelerations_scaled()
    plain = {f"plain_{n}": c for n, c in T.accelerations_plain().items()}
    df = T.add(obs(spark, folder), T.lag_features((1, 3, 7, 14)))
    return pick(T.add(df, d, m, a, plain), d, m, a, plain)


@query("d05_trend_slope", feature_sql(slopes((7, 14, 30)), "FROM n", f"WITH {NUMBERED}"))
def d05(spark, folder):
    s = T.trend_slope()
    return pick(T.add(T.price_sums(obs(spark, folder)), s), s)


def recursive_ewma(source: str, cols):
    """num/den recursions per span; adjust = False is the same recursion with a fixed weight."""
    init, step, out = [], [], []
    for name, x, span, adjust in cols:
        a = f"(2.0::DOUBLE / {span + 1})"
        if adjust:
            init += [f"{x} AS n_{name}", f"CASE WHEN {x} IS NULL THEN NULL ELSE 1.0::DOUBLE END AS d_{name}"]
            step += [f"coalesce(s.{x} + (1 - {a}) * e.n_{name}, s.{x}, e.n_{name} * (1 - {a}))",
                     f"CASE WHEN e.d_{name} IS NULL THEN CASE WHEN s.{x} IS NULL THEN NULL ELSE 1.0 END ELSE 1 + (1 - {a}) * e.d_{name} END"]
            out.append((name, f"coalesce(n_{name} / d_{name}, 0)"))
        else:
            init.append(f"{x} AS n_{name}")
            step.append(f"{a} * s.{x} + (1 - {a}) * e.n_{name}")
            out.append((name, f"n_{name}"))
    cte = f"""e AS (SELECT commodity, market, variety, reported_date, rn, {', '.join(init)} FROM {source} WHERE rn = 1
  UNION ALL SELECT s.commodity, s.market, s.variety, s.reported_date, s.rn, {', '.join(step)}
  FROM e JOIN {source} s ON s.market = e.market AND s.variety = e.variety AND s.rn = e.rn + 1)"""
    return cte, out


EWMA_PRICE = [(f"ewma_{s}", P, s, False) for s in (5, 7, 14, 30)]
VOL_EWMA = [("ewma_abs_diff_5", "abs_diff", 5, True), ("ewma_abs_diff_14", "abs_diff", 14, True),
            ("ewma_pct_vol_5", "abs_pct", 5, True), ("ewma_pct_vol_14", "abs_pct", 14, True)]
DIFFED = f"""{NUMBERED},
dd AS (SELECT *, abs({P} - prev) AS abs_diff, abs(({P} - prev) / (prev + {E4}) * 100) AS abs_pct
       FROM (SELECT *, {lag(P)} AS prev FROM n))"""
_CTE_P, _OUT_P = recursive_ewma("n", EWMA_PRICE)
_CTE_V, _OUT_V = recursive_ewma("dd", VOL_EWMA)


@query("d06_ewma_price", feature_sql(_OUT_P, "FROM e", f"WITH RECURSIVE {NUMBERED},\n{_CTE_P}"))
def d06(spark, folder):
    df = T.ewma(obs(spark, folder), [(f"ewma_{s}", P, s, False) for s in (5, 7, 14, 30)])
    return df.select(*KEY, *[f"ewma_{s}" for s in (5, 7, 14, 30)])


@query("d06_ewma_volatility", feature_sql(_OUT_V, "FROM e", f"WITH RECURSIVE {DIFFED},\n{_CTE_V}"))
def d06v(spark, folder):
    w = T.series_window()
    before = F.lag(P).over(w)
    df = obs(spark, folder).withColumns({
        "abs_diff": F.abs(F.col(P) - before), "abs_pct": F.abs((F.col(P) - before) / (before + 1e-4) * 100)})
    specs = [(n, x, s, a) for n, x, s, a in VOL_EWMA]
    return T.ewma(df, specs, missing_as_zero=True).select(*KEY, *[n for n, *_ in specs])


ROLLED = ("r AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in means((7, 14, 30)) + stds((7, 14))) + " FROM @obs@)")


def ratio_sql(z, eps, with_ratio=True):
    out = []
    for n in (7, 14):
        if with_ratio:
            out.append((f"price_to_rolling_mean_{n}", f"{P} / (rolling_mean_{n} + {E4})"))
        out += [(f"gap_mean_{n}", f"{P} - rolling_mean_{n}"), (f"{z}_{n}", f"({P} - rolling_mean_{n}) / (rolling_std_{n} + {eps})")]
    return out


@query("d07_level_ratios", feature_sql(
    ratio_sql("price_zscore", E4) + [e for e in ratio_sql("zscore", E5, False) if e[0].startswith("z")],
    "FROM r", f"WITH {ROLLED}"))
def d07(spark, folder):
    df = T.add(obs(spark, folder), T.rolling_mean((7, 14)), T.or_zero(T.rolling_std((7, 14))))
    a = T.level_ratios()
    b = {n: c for n, c in T.level_ratios(eps=1e-5, z="zscore", with_ratio=False).items() if n.startswith("z")}
    return pick(T.add(df, a, b), a, b)


ARRIVAL_SQL = (lags((1, 3, 7), ARR, "arrival_lag") + means((7, 14), ARR, "arrival_rolling_mean")
               + stds((7,), ARR, "arrival_rolling_std", zero=False))


@query("d08_arrival_features", feature_sql(ARRIVAL_SQL + [("arrival_change", f"{lag(ARR, 1)} - {lag(ARR, 2)}")]))
def d08(spark, folder):
    f = T.arrival_features((1, 3, 7), (7, 14), (7,), change=True)
    return pick(T.add(obs(spark, folder), f), f)


PCTS = [pct(P, "price_pct_change"), pct(ARR, "arrival_pct_change")]


@query("d09_pct_changes", feature_sql(
    [(n, n) for n, _ in PCTS] + [("arrival_price_interaction", f"ln(1 + greatest({ARR}, 0)) * price_pct_change")],
    "FROM q", "WITH q AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in PCTS) + " FROM @obs@)"))
def d09(spark, folder):
    f = T.pct_changes()
    df = T.add(obs(spark, folder), f)
    return pick(T.add(df, T.arrival_interaction()), f, T.arrival_interaction())


def moves(first, eps):
    return f"""mv AS (SELECT *, CASE WHEN d IS NULL THEN {int(first)} WHEN abs(d) > {eps} THEN 1 ELSE 0 END AS move,
  CASE WHEN d > {eps} THEN 1 ELSE 0 END AS pos, CASE WHEN d < -{eps} THEN 1 ELSE 0 END AS neg,
  CASE WHEN abs(d) <= {eps} THEN 1 ELSE 0 END AS flat
  FROM (SELECT *, {P} - {lag(P)} AS d FROM @obs@)),
bl AS (SELECT *, sum(1 - flat) OVER {rows(-100000, 0)} AS bf, sum(move) OVER {rows(-100000, 0)} AS bm,
  sum(1 - pos) OVER {rows(-100000, 0)} AS bp, sum(1 - neg) OVER {rows(-100000, 0)} AS bn FROM mv)"""


def streak_sql(flag, block):
    return (f"CAST(sum({flag}) OVER (PARTITION BY commodity, market, variety, {block} ORDER BY reported_date "
            f"ROWS UNBOUNDED PRECEDING) AS INTEGER)")


MOVE_COUNTS = ([(f"move_count_{n}", strict("sum", "move", n, -(n - 1), 0)) for n in (7, 14, 30)]
               + [("pos_count_7", strict("sum", "pos", 7, -6, 0)), ("neg_count_7", strict("sum", "neg", 7, -6, 0))])
LAST_MOVE = [("last_non_zero_move", f"coalesce(last_value(nullif(d, 0) IGNORE NULLS) OVER {rows(-100000, 0)}, 0)"),
             ("last_move_abs", f"abs(coalesce(last_value(nullif(d, 0) IGNORE NULLS) OVER {rows(-100000, 0)}, 0))")]


def changes(df):
    return df.withColumn("price_change_1", F.col(P) - F.lag(P).over(T.series_window()))


@query("d10_movement_counts", feature_sql(
    MOVE_COUNTS + [(f"nonzero_moves_{n}", strict("sum", "move", n, -(n - 1), 0)) for n in (5, 10)],
    "FROM bl", f"WITH {moves(False, 0)}"))
def d10(spark, folder):
    df = T.add(changes(obs(spark, folder)), T.move_flags(False))
    c = T.movement_counts()
    five = {f"nonzero_moves_{n}": v for n, v in zip((5, 10), T.movement_counts((5, 10), ()).values())}
    return pick(T.add(df, c, five), c, five)


@query("d11_streaks", feature_sql(
    [("#streak_zero", streak_sql("flat", "bf")), ("#streak_pos", streak_sql("pos", "bp")), ("#streak_neg", streak_sql("neg", "bn"))],
    "FROM bl", f"WITH {moves(False, 0)}"))
def d11(spark, folder):
    df = T.add(changes(obs(spark, folder)), T.move_flags(False), T.row_numbers())
    s = {"streak_zero": T.streak(F.col("_flat") == 1), "streak_pos": T.streak(F.col("_pos") == 1),
         "streak_neg": T.streak(F.col("_neg") == 1)}
    return pick(T.add(df, s), s)


@query("d12_last_nonzero_move", feature_sql(LAST_MOVE, "FROM bl", f"WITH {moves(False, 0)}"))
def d12(spark, folder):
    f = T.last_nonzero_move()
    return pick(T.add(changes(obs(spark, folder)), f), f)


def obs_range(n):
    return f"{strict('max', P, n, -(n - 1), 0)} - min({P}) OVER {rows(-(n - 1), 0)}"


RANGES = [x for n in (5, 10, 20) for x in
          ((f"past_{n}_range", obs_range(n)), (f"past_{n}_pct_range", f"({obs_range(n)}) / ({P} + {E4}) * 100"))]


@query("d13_past_obs_range", feature_sql(RANGES))
def d13(spark, folder):
    f = T.past_obs_range()
    return pick(T.add(obs(spark, folder), f), f)


def cal_range(h):
    f = days(-h, 0)
    return f"CASE WHEN {P} > 0 AND count(*) FILTER ({P} > 0) OVER {f} > 1 THEN max({P}) FILTER ({P} > 0) OVER {f} - min({P}) FILTER ({P} > 0) OVER {f} ELSE 0 END"


CAL_RANGES = [("past_7d_range", cal_range(7)), ("past_7d_pct_range", f"({cal_range(7)}) / ({P} + {E4}) * 100"),
              ("past_14d_pct_range", f"({cal_range(14)}) / ({P} + {E4}) * 100")]


@query("d14_past_calendar_range", feature_sql(CAL_RANGES))
def d14(spark, folder):
    f = T.past_calendar_range()
    return pick(T.add(obs(spark, folder), f), f)


PCT_BASE = (f"pc AS (SELECT *, ({P} - l1) / (l1 + {E4}) * 100 AS pct_change_1, (l1 - l2) / (l2 + {E4}) * 100 AS pct_change_2, "
            f"({P} - l5) / (l5 + {E4}) * 100 AS pct_change_5 FROM (SELECT *, {lag(P, 1)} AS l1, {lag(P, 2)} AS l2, "
            f"{lag(P, 5)} AS l5 FROM @obs@))")
STD_INCL = stds((5, 7, 14, 30), incl=True) + stds((5, 14), "pct_change_1", "rolling_std_pct", incl=True)


@query("d15_rolling_std_incl", feature_sql(STD_INCL, "FROM pc", f"WITH {PCT_BASE}"))
def d15(spark, folder):
    f = T.rolling_std_incl()
    return pick(T.add(T.add(obs(spark, folder), T.lagged_pct()), f), f)


MEAN_INCL = strict("avg", P, 7, -6, 0)
JUMP = strict("max", "abs(pct_change_1)", 5, -4, 0)
VOL_BASE = (f"{PCT_BASE},\nvb AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in RANGES + STD_INCL)
            + f", {JUMP} AS jump, {MEAN_INCL} AS m7 FROM pc)")
VOL_RATIOS = [("vol_trend_5_10", f"past_5_range / (past_10_range + {E4})"),
              ("vol_pct_trend_5_10", f"past_5_pct_range / (past_10_pct_range + {E4})"),
              ("vol_std_ratio_5_14", f"rolling_std_5 / (rolling_std_14 + {E4})"),
              ("max_daily_pct_jump_5", "jump"), ("price_level", P), ("price_to_mean_7", f"{P} / (m7 + {E4})")]


@query("d16_volatility_ratios", feature_sql(VOL_RATIOS, "FROM vb", f"WITH {VOL_BASE}"))
def d16(spark, folder):
    df = T.add(obs(spark, folder), T.lagged_pct(), T.past_obs_range())
    r, j = T.volatility_ratios(), T.level_and_jump()
    return pick(T.add(T.add(df, T.rolling_std_incl()), r, j), r, j)


PCT_SQL = [("pct_change_1", "pct_change_1"), ("pct_change_2", "pct_change_2"), ("pct_change_5", "pct_change_5"),
           ("abs_pct_change_1", "abs(pct_change_1)"), ("abs_pct_change_5", "abs(pct_change_5)")]


@query("d17_lagged_pct", feature_sql(PCT_SQL, "FROM pc", f"WITH {PCT_BASE}"))
def d17(spark, folder):
    f = T.lagged_pct()
    return pick(T.add(obs(spark, folder), f), f)


_IMP = ("lag_7", "rolling_mean_14", "arrival_lag_1")
_IMP_SRC = "i AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in (
    lags((7,)) + means((14,)) + lags((1,), ARR, "arrival_lag"))) + " FROM @obs@)"


@query("d18_impute_lags", feature_sql(
    [(c, f"coalesce(f_{c}, (SELECT quantile_cont(f_{c}, 0.5) FROM g))") for c in _IMP], "FROM g",
    f"WITH {_IMP_SRC},\ng AS (SELECT *, " + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER {rows(-100000, 0)} AS f_{c}" for c in _IMP) + " FROM i)"))
def d18(spark, folder):
    df = T.add(obs(spark, folder), T.lag_features((7,)), T.rolling_mean((14,)), T.arrival_features((1,), ()))
    return T.impute_lags(df, _IMP).select(*KEY, *_IMP)


@query("d19_ordinal_encode", """
WITH t AS (SELECT *, market || '/' || variety AS pair FROM @obs@),
tr AS (SELECT * FROM t WHERE reported_date < DATE '1996-01-01' AND market <> 'NATION_3' AND variety <> 'R'),
m AS (SELECT market, CAST(dense_rank() OVER (ORDER BY market) - 1 AS INTEGER) AS c FROM (SELECT DISTINCT market FROM tr)),
v AS (SELECT variety, CAST(dense_rank() OVER (ORDER BY variety) - 1 AS INTEGER) AS c FROM (SELECT DISTINCT variety FROM tr)),
p AS (SELECT pair, CAST(dense_rank() OVER (ORDER BY pair) - 1 AS INTEGER) AS c FROM (SELECT DISTINCT pair FROM tr))
SELECT market, variety, coalesce(m.c, -1) AS market_code, coalesce(v.c, -1) AS variety_code, coalesce(p.c, -1) AS pair_code,
  count(*) AS n
FROM t LEFT JOIN m USING (market) LEFT JOIN v USING (variety) LEFT JOIN p USING (pair) GROUP BY ALL""")
def d19(spark, folder):
    df = obs(spark, folder).withColumn("pair", F.concat_ws("/", "market", "variety"))
    train = df.filter("reported_date < '1996-01-01' AND market <> 'NATION_3' AND variety <> 'R'")
    out = T.ordinal_encode(df, train, ["market", "variety", "pair"])
    return out.groupBy("market", "variety", "market_code", "variety_code", "pair_code").agg(F.count("*").alias("n"))


@query("d20_target_encode", """
WITH tr AS (SELECT * FROM @panel@ WHERE year < 1998 AND district <> 'NATION_3'),
m AS (SELECT district, avg(yield_kg_ha) AS e FROM tr GROUP BY district)
SELECT district, season, year,
  ~coalesce(e, (SELECT avg(yield_kg_ha) FROM tr)) AS district_mean
FROM @panel@ LEFT JOIN m USING (district)""")
def d20(spark, folder):
    panel = A.yield_panel(spark, folder)
    train = panel.filter("year < 1998 AND district <> 'NATION_3'")
    return T.target_encode(panel, train, "district", "yield_kg_ha", "district_mean").select(
        "district", "season", "year", "district_mean")


PL = lambda c, k: lag(c, k, part="district, season", order="year")


@query("d21_yield_row_lags", f"""
WITH l AS (SELECT *, {PL('yield_kg_ha', 1)} AS y1, {PL('yield_kg_ha', 2)} AS y2, {PL('area', 1)} AS area_lag1,
    {PL('area', 2)} AS area_lag2, {PL('production', 1)} AS p1, avg(yield_kg_ha) OVER (
      PARTITION BY district, season ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM @panel@)
SELECT district, season, year, area_lag1, area_lag2,
  ~yield_kg_ha AS yield_kg_ha,
  ~y1 AS yield_lag1,
  ~y2 AS yield_lag2,
  ~p1 AS precip_lag1,
  ~h AS yield_hist_mean
FROM l WHERE year >= 1997""")
def d21(spark, folder):
    panel = A.yield_panel(spark, folder).withColumn("precip", F.col("production"))
    return T.yield_row_lags(panel, 1997)


@query("d22_expanding_past_mean", """
SELECT district, season, year,
  ~avg(yield_kg_ha) OVER (PARTITION BY district, season ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS yield_hist_mean
FROM @panel@""")
def d22(spark, folder):
    return A.yield_panel(spark, folder).select(
        "district", "season", "year", T.expanding_past_mean().alias("yield_hist_mean"))


@query("d23_rolling_past_min1", f"""
WITH l AS (SELECT *, {PL('yield_kg_ha', 1)} AS y1, {PL('yield_kg_ha', 2)} AS y2, {PL('area', 1)} AS a1,
  avg(yield_kg_ha) OVER (PARTITION BY district, season ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3 FROM @panel@)
SELECT district, season, year, coalesce(a1, area) AS area_lag1,
  ~y1 AS yield_lag1,
  ~coalesce(y2, y1) AS yield_lag2,
  ~coalesce(m3, y1) AS yield_roll_mean3,
  ~ln(1 + coalesce(a1, area)) AS log_area_lag1
FROM l WHERE y1 IS NOT NULL""")
def d23(spark, folder):
    return T.rolling_yield_features(A.yield_panel(spark, folder), ("district", "season")).select(
        "district", "season", "year", "area_lag1", "yield_lag1", "yield_lag2", "yield_roll_mean3", "log_area_lag1")


def _latest_sql():
    first = lambda c: f"first_value({c}) OVER {rows(-100000, 0)}"
    cols = [(f"lag_{k}", f"coalesce({lag(P, k)}, {first(P)})") for k in (1, 7, 14, 30)]
    cols += [(f"rolling_mean_{n}", f"coalesce(avg({P}) OVER {rows(-n, -1)}, {P})") for n in (7, 14, 30)]
    cols += [(f"rolling_std_{n}", f"coalesce(stddev_pop({P}) OVER {rows(-n, -1)}, 0)") for n in (7, 14)]
    cols += [(f"arrival_lag_{k}", f"coalesce({lag(ARR, k)}, {first(ARR)})") for k in (1, 7)]
    cols += [(f"arrival_rolling_mean_{n}", f"coalesce(avg({ARR}) OVER {rows(-n, -1)}, {ARR})") for n in (7, 14)]
    cols += [(n, f"coalesce(({c} - {lag(c)}) / nullif({lag(c)}, 0) * 100, 0)") for c, n in (
        (P, "price_pct_change"), (ARR, "arrival_pct_change"))]
    inner = ", ".join(f"{e} AS {n}" for n, e in cols)
    out = ",\n".join(f"  ~{n} AS {n}" for n, _ in cols)
    parts = ", ".join(f"CAST({CAL[n]} AS INTEGER) AS {n}" for n in ("year", "month", "day", "day_of_week", "week_of_year"))
    return f"""
WITH s AS (SELECT * FROM @obs@ UNION ALL SELECT * REPLACE ('early' AS commodity) FROM @obs@
  WHERE reported_date < CASE WHEN variety = 'A' THEN DATE '1995-02-10' ELSE DATE '1999-01-01' END),
l AS (SELECT *, {inner}, row_number() OVER (PARTITION BY commodity, market, variety ORDER BY reported_date DESC) AS back FROM s)
SELECT commodity, market, variety, reported_date, modal_price, {parts}, 0.0::DOUBLE AS price_spread, 0.5::DOUBLE AS price_position_in_range,
{out}
FROM l WHERE back = 1"""


@query("d24_latest_feature_row", _latest_sql())
def d24(spark, folder):
    # whole series, and beside them the same series as they were early on, when some were short
    df = obs(spark, folder).select(*T.SERIES, "reported_date", P, ARR)
    early = df.filter("reported_date < CASE WHEN variety = 'A' THEN DATE'1995-02-10' ELSE DATE'1999-01-01' END")
    return T.latest_feature_row(df.union(early.withColumn("commodity", F.lit("early")))).drop(ARR)


CORE_SQL = (lags((1, 7, 14, 30)) + means((7, 14, 30)) + stds((7, 14), zero=False) + cal(*T.CALENDAR)
            + lags((1, 7), ARR, "arrival_lag") + means((7, 14), ARR, "arrival_rolling_mean") + PCTS)


@query("d25_core_20", feature_sql(CORE_SQL))
def d25(spark, folder):
    return T.core_20(obs(spark, folder)).select(*KEY, *T.CORE_20)


def staged(columns, source):
    """SELECT list computing plain (unrounded) columns."""
    return ", ".join(f"{e} AS {n.lstrip('#')}" for n, e in columns)


_S1 = (lags((1, 7, 14, 30)) + means((7, 14, 30)) + stds((7, 14)) + lags((1, 7), ARR, "arrival_lag")
       + means((7, 14), ARR, "arrival_rolling_mean") + PCTS + slopes((7, 14, 30)) + medians((7, 14, 30), True))
_P48 = (f"{moves(True, 0)},\nnn AS (SELECT *, row_number() OVER (PARTITION BY commodity, market, variety ORDER BY reported_date) AS rn FROM bl),\n"
        f"s1 AS (SELECT *, {staged(_S1, 'nn')}, {staged(MOVE_COUNTS + LAST_MOVE, 'nn')} FROM nn),\n"
        f"s2 AS (SELECT *, {P} - lag_1 AS price_change_1, {P} - lag_7 AS price_change_7, {P} - lag_14 AS price_change_14 FROM s1),\n"
        "n AS (SELECT * FROM nn)")
# streaks of the 48-column set: a row that is not a move is flat
_STREAK48 = [("#streak_zero", streak_sql("(1 - move)", "bm")), ("#streak_pos", streak_sql("pos", "bp")),
             ("#streak_neg", streak_sql("neg", "bn"))]
_E48, _OUT48 = recursive_ewma("n", [(f"ewma_{s}", P, s, False) for s in (7, 14, 30)])
_P48_OUT = ([(n, n) for n, _ in _S1] + cal(*T.CALENDAR) + [(f"price_change_{k}", f"price_change_{k}") for k in (1, 7, 14)]
            + [("accel_1_7", "price_change_1 - price_change_7"), ("accel_1_14", "price_change_1 - price_change_14")]
            + ratio_sql("zscore", E5, False) + [(n, n) for n, _ in MOVE_COUNTS + LAST_MOVE])


@query("d26_price_48", feature_sql(
    _P48_OUT + [(n, n) for n in ("streak_zero", "streak_pos", "streak_neg")][0:0]
    + [(f"#{n}", n) for n in ("streak_zero", "streak_pos", "streak_neg")] + _OUT48,
    "FROM s3 JOIN (SELECT market AS em, variety AS ev, reported_date AS ed, n_ewma_7, n_ewma_14, n_ewma_30 FROM e) "
    "ON market = em AND variety = ev AND reported_date = ed",
    f"WITH RECURSIVE {_P48},\n{_E48},\ns3 AS (SELECT *, {staged(_STREAK48, 's2')} FROM s2)"))
def d26(spark, folder):
    return T.price_48(obs(spark, folder)).select(*KEY, *T.PRICE_48)


_V1 = (lags((1, 2, 3, 5, 7, 10, 14, 21, 30)) + means((3, 5, 7, 14, 30)) + stds((5, 7, 14, 30)) + medians((7, 14), False)
       + [("rolling_min_7", strict("min", P, 7, -7, -1)), ("rolling_max_7", strict("max", P, 7, -7, -1))] + slopes((7, 14, 30))
       + lags((1, 3, 7), ARR, "arrival_lag") + means((7, 14), ARR, "arrival_rolling_mean")
       + stds((7,), ARR, "arrival_rolling_std") + PCTS)
_CV2 = (f"{moves(False, E4)},\nnn AS (SELECT *, row_number() OVER (PARTITION BY commodity, market, variety ORDER BY reported_date) AS rn FROM bl),\n"
        f"s1 AS (SELECT *, {staged(_V1, 'nn')}, {staged(MOVE_COUNTS + LAST_MOVE, 'nn')}, {streak_sql('(1 - move)', 'bm')} AS streak_zero FROM nn),\n"
        f"s2 AS (SELECT *, {_changes((1, 3, 7, 14))} FROM s1),\nn AS (SELECT * FROM nn)")
_ECV2, _OUTCV2 = recursive_ewma("n", EWMA_PRICE)
_STRUCT = [("price_spread", "max_price - min_price"),
           ("price_position_in_range", f"least(greatest(({P} - min_price) / greatest(max_price - min_price, {E4}), 0), 1)"),
           ("min_to_modal_ratio", f"min_price / ({P} + {E4})"), ("modal_to_max_ratio", f"{P} / (max_price + {E4})")]
_CV2_OUT = ([(n, n) for n, _ in _V1] + [(f"price_change_{k}", f"price_change_{k}") for k in (1, 3, 7, 14)] + MOMENTUM + ACCEL
            + ratio_sql("price_zscore", E4) + [("arrival_price_interaction", f"ln(1 + greatest({ARR}, 0)) * price_pct_change")]
            + cal("year", "month", "day_of_week", "week_of_year", "quarter")
            + [("annual_sin", "sin(2 * pi() * dayofyear(reported_date) / 365.25)"),
               ("annual_cos", "cos(2 * pi() * dayofyear(reported_date) / 365.25)")]
            + _STRUCT + [(n, n) for n, _ in MOVE_COUNTS + LAST_MOVE] + [("#streak_zero", "streak_zero")] + _OUTCV2
            + [("rolling_range_7", "rolling_max_7 - rolling_min_7"),
               ("rolling_pct_range_7", f"(rolling_max_7 - rolling_min_7) / ({P} + {E4}) * 100"),
               ("price_to_rolling_mean_30", f"{P} / (rolling_mean_30 + {E4})")]
            + [(f"rolling_pct_std_{n}", f"rolling_std_{n} / ({P} + {E4}) * 100") for n in (7, 14, 30)])


@query("d27_candidate_v2", feature_sql(
    _CV2_OUT, "FROM s2 JOIN (SELECT market AS em, variety AS ev, reported_date AS ed, n_ewma_5, n_ewma_7, n_ewma_14, n_ewma_30 FROM e) "
    "ON market = em AND variety = ev AND reported_date = ed", f"WITH RECURSIVE {_CV2},\n{_ECV2}"))
def d27(spark, folder):
    return T.candidate_v2(obs(spark, folder)).drop("commodity", "min_price", "max_price", P, ARR)


def vol_sql(first, names):
    src = (f"{moves(first, 0)},\npc AS (SELECT *, ({P} - l1) / (l1 + {E4}) * 100 AS pct_change_1, "
           f"(l1 - l2) / (l2 + {E4}) * 100 AS pct_change_2, ({P} - l5) / (l5 + {E4}) * 100 AS pct_change_5, abs({P} - l1) AS abs_diff, "
           f"abs(({P} - l1) / (l1 + {E4}) * 100) AS abs_pct, "
           f"row_number() OVER (PARTITION BY commodity, market, variety ORDER BY reported_date) AS rn "
           f"FROM (SELECT *, {lag(P, 1)} AS l1, {lag(P, 2)} AS l2, {lag(P, 5)} AS l5 FROM bl)),\n"
           f"vb AS (SELECT *, {staged(RANGES + STD_INCL + CAL_RANGES, 'pc')}, {JUMP} AS jump, {MEAN_INCL} AS m7, "
           f"{strict('sum', 'move', 5, -4, 0)} AS nonzero_moves_5, {strict('sum', 'move', 10, -9, 0)} AS nonzero_moves_10, "
           f"{lag(ARR, 1)} AS arrival_lag_1, {strict('avg', ARR, 7, -7, -1)} AS arrival_rolling_mean_7 FROM pc),\n"
           f"vs AS (SELECT *, {streak_sql('flat', 'bf')} AS streak_zero FROM vb)")
    e, out = recursive_ewma("pc", VOL_EWMA)
    exprs = dict(PCT_SQL) | {n: n for n, _ in RANGES + STD_INCL + CAL_RANGES} | dict(VOL_RATIOS) | dict(out)
    exprs |= {n: n for n in ("nonzero_moves_5", "nonzero_moves_10", "streak_zero", "arrival_lag_1", "arrival_rolling_mean_7")}
    cols = []
    for n in names:
        if n in ("month", "day_of_week", "week_of_year"):
            cols += cal(n)
        else:
            cols.append((n, f"coalesce({exprs[n]}, 0)"))
    joined = ("FROM vs JOIN (SELECT market AS em, variety AS ev, reported_date AS ed, "
              + ", ".join(f"n_{n}, d_{n}" for n, *_ in VOL_EWMA) + " FROM e) ON market = em AND variety = ev AND reported_date = ed")
    return feature_sql(cols, joined, f"WITH RECURSIVE {src},\n{e}")


@query("d28_vol_35", vol_sql(True, T.VOL_35))
def d28(spark, folder):
    return T.vol_35(obs(spark, folder)).select(*KEY, *T.VOL_35)


@query("d28_vol_38", vol_sql(False, T.VOL_38))
def d28b(spark, folder):
    return T.vol_38(obs(spark, folder)).select(*KEY, *T.VOL_38)
