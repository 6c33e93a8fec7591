"""Cleaning, validation and batch normalisation."""

from pyspark.sql import functions as F

from granary.operators import cleaning as C
from granary.plans.registry import lag, query, strict
from granary.schemas import OBS_KEY
from granary.sources import adapters as A
from granary.sources import tables as S


def typed(spark, folder):
    return S.typed_observations(A.raw_observations(spark, folder))


ORDER_ALL = ("commodity, state, district, market, variety, \"group\", arrivals NULLS FIRST, min_price NULLS FIRST,"
             " max_price NULLS FIRST, modal_price NULLS FIRST")
_RULES = f"""
dated AS (SELECT DISTINCT * FROM @typed@ WHERE reported_date IS NOT NULL),
bounded AS (SELECT * EXCLUDE (min_price, max_price), CASE WHEN min_price > 0 THEN min_price END AS min_price,
    CASE WHEN max_price > 0 THEN max_price END AS max_price
  FROM dated WHERE arrivals >= 0 AND modal_price > 0),
consistent AS (SELECT * FROM bounded WHERE NOT coalesce(min_price IS NOT NULL AND max_price IS NOT NULL
    AND (min_price > max_price OR modal_price < min_price OR modal_price > max_price), false)),
cleaned AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY commodity, market, variety, reported_date ORDER BY {ORDER_ALL}) AS rn FROM consistent) WHERE rn = 1)"""


@query("b01_drop_duplicates", f"""
WITH {_RULES.strip()}
SELECT market, variety, count(*) AS n, min(reported_date) AS first_date FROM dated GROUP BY ALL""")
def b01(spark, folder):
    df = C.drop_exact_duplicates(C.drop_invalid_dates(typed(spark, folder)))
    return df.groupBy("market", "variety").agg(F.count("*").alias("n"), F.min("reported_date").alias("first_date"))


@query("b02_validate_arrivals", """
SELECT market, count(*) FILTER (arrivals >= 0) AS kept,
  ~sum(greatest(coalesce(arrivals, 0), 0)) AS clamped_total,
  count(*) AS n
FROM @typed@ GROUP BY market""")
def b02(spark, folder):
    df = typed(spark, folder)
    kept = C.validate_arrivals(df, "drop").groupBy("market").agg(F.count("*").alias("kept"))
    clamped = C.validate_arrivals(df, "clamp").groupBy("market").agg(
        F.sum("arrivals").alias("clamped_total"), F.count("*").alias("n"))
    return clamped.join(kept, "market", "left").select(
        "market", F.coalesce("kept", F.lit(0)).alias("kept"), "clamped_total", "n")


@query("b03_validate_price", """
SELECT market, variety, count(*) AS n, min(modal_price) AS lo FROM @typed@ WHERE modal_price > 0 GROUP BY ALL""")
def b03(spark, folder):
    return C.validate_price(typed(spark, folder)).groupBy("market", "variety").agg(
        F.count("*").alias("n"), F.min("modal_price").alias("lo"))


@query("b04_nullify_nonpositive_bounds", """
SELECT market, count(*) FILTER (min_price > 0) AS with_min, count(*) FILTER (max_price > 0) AS with_max,
  count(*) AS n FROM @typed@ GROUP BY market""")
def b04(spark, folder):
    return C.nullify_nonpositive_bounds(typed(spark, folder)).groupBy("market").agg(
        F.count("min_price").alias("with_min"), F.count("max_price").alias("with_max"), F.count("*").alias("n"))


@query("b05_drop_inconsistent_prices", """
SELECT market, variety, count(*) AS n FROM @typed@
WHERE NOT coalesce(min_price > max_price OR modal_price < min_price OR modal_price > max_price, false) GROUP BY ALL""")
def b05(spark, folder):
    return C.drop_inconsistent_prices(typed(spark, folder)).groupBy("market", "variety").agg(F.count("*").alias("n"))


@query("b06_dedup_keyed_first", f"""
SELECT * EXCLUDE (rn) FROM (SELECT commodity, market, variety, reported_date, min_price, max_price, modal_price,
  arrivals, row_number() OVER (PARTITION BY commodity, market, variety, reported_date ORDER BY {ORDER_ALL}) AS rn
  FROM @typed@) WHERE rn = 1""")
def b06(spark, folder):
    return C.dedup_keyed(typed(spark, folder)).select(
        *OBS_KEY, "min_price", "max_price", "modal_price", "arrivals")


@query("b06_dedup_keyed_last", """
SELECT * EXCLUDE (rn) FROM (SELECT commodity, market, variety, reported_date, modal_price, arrivals,
  row_number() OVER (PARTITION BY commodity, market, variety, reported_date
                     ORDER BY modal_price DESC NULLS LAST, arrivals DESC NULLS LAST) AS rn FROM @typed@) WHERE rn = 1""")
def b06l(spark, folder):
    df = typed(spark, folder).select(*OBS_KEY, "modal_price", "arrivals")
    return C.dedup_keyed(df, OBS_KEY, "last", ["modal_price", "arrivals"])


@query("b07_clean_observations", f"""
WITH {_RULES.strip()}
SELECT commodity, market, variety, reported_date, min_price, max_price, modal_price, arrivals FROM cleaned""")
def b07(spark, folder):
    return C.clean_observations(typed(spark, folder)).select(
        *OBS_KEY, "min_price", "max_price", "modal_price", "arrivals")


@query("b07_clean_audit", f"""
WITH {_RULES.strip()},
alive AS (SELECT count(*) AS final_rows, min(reported_date) AS first_date, max(reported_date) AS last_date,
  count(DISTINCT market) AS markets, count(DISTINCT variety) AS varieties FROM cleaned)
SELECT (SELECT count(*) FROM @typed@) AS raw_rows,
  (SELECT count(*) FROM @typed@ WHERE reported_date IS NULL) AS invalid_dates,
  (SELECT count(*) FROM @typed@ WHERE reported_date IS NOT NULL) - (SELECT count(*) FROM dated) AS exact_duplicates,
  (SELECT count(*) FROM dated WHERE NOT coalesce(arrivals >= 0, false)) AS bad_arrivals,
  (SELECT count(*) FROM dated WHERE arrivals >= 0 AND NOT coalesce(modal_price > 0, false)) AS bad_prices,
  (SELECT count(*) FROM bounded) - (SELECT count(*) FROM consistent) AS inconsistent,
  (SELECT count(*) FROM consistent) - final_rows AS keyed_duplicates,
  final_rows, first_date, last_date, markets, varieties FROM alive""")
def b07a(spark, folder):
    return C.clean_audit(typed(spark, folder))


_JUMP = f"""
j AS (SELECT *, (modal_price - prev) / nullif(prev, 0) * 100 AS pct_jump FROM (
  SELECT *, {lag('modal_price')} AS prev FROM @obs@))"""


@query("b08_flag_extreme_jumps", f"""
WITH {_JUMP.strip()}
SELECT market, variety, reported_date, modal_price, prev AS previous_price,
  ~pct_jump AS pct_jump,
  coalesce(abs(pct_jump) > 300, false) AS extreme_jump
FROM j""")
def b08(spark, folder):
    return C.flag_extreme_jumps(A.observations(spark, folder)).select(
        "market", "variety", "reported_date", "modal_price", "previous_price", "pct_jump", "extreme_jump")


@query("b09_price_jump_report", f"""
WITH {_JUMP.strip()}
SELECT market, variety, reported_date, modal_price, prev AS previous_price,
  ~pct_jump AS pct_jump,
  CASE WHEN pct_jump > 0 THEN 'up' ELSE 'down' END AS direction
FROM j WHERE abs(pct_jump) >= 100""")
def b09(spark, folder):
    return C.price_jump_report(A.observations(spark, folder)).select(
        "market", "variety", "reported_date", "modal_price", "previous_price", "pct_jump", "direction")


@query("b09_price_jump_counts", f"""
WITH {_JUMP.strip()}
SELECT count(*) AS n_rows, count(*) FILTER (pct_jump >= 50) AS up, count(*) FILTER (pct_jump <= -50) AS down FROM j""")
def b09c(spark, folder):
    return C.price_jump_counts(A.observations(spark, folder), 0.5)


@query("b10_price_anomaly_report", """
WITH f AS (SELECT *, coalesce(greatest(min_price, max_price, modal_price) > 50000, false) AS above_cap,
  coalesce(min_price IS NOT NULL AND max_price IS NOT NULL AND (min_price > max_price OR modal_price < min_price
           OR modal_price > max_price), false) AS outside_bounds FROM @typed@)
SELECT market, above_cap, outside_bounds, count(*) AS n FROM f WHERE above_cap OR outside_bounds GROUP BY ALL""")
def b10(spark, folder):
    return (C.price_anomaly_rows(typed(spark, folder), 50000.0)
            .groupBy("market", "above_cap", "outside_bounds").agg(F.count("*").alias("n")))


@query("b10_price_anomaly_stats", """
WITH u AS (UNPIVOT (SELECT min_price, max_price, modal_price FROM @typed@)
           ON min_price, max_price, modal_price INTO NAME price_column VALUE value)
SELECT price_column, min(value) AS min, max(value) AS max, count(*) FILTER (value > 50000) AS above_cap,
  ~quantile_cont(value, 0.5) AS median
FROM u GROUP BY ALL""")
def b10s(spark, folder):
    return C.price_anomaly_stats(typed(spark, folder), 50000.0)


def _spellings(spark, folder):
    """Spelling tables drawn from the data: codes, own-commodity names and one foreign commodity."""
    nation = S.table(spark, folder, "nation")
    k, name = F.col("n_nationkey"), F.col("n_name")
    row = lambda c, s, n, r: F.struct(c.cast("string").alias("commodity"), s.alias("spelling"),
                                      n.alias("name"), F.lit(r).alias("rank"), F.lit(0).alias("pos"))
    null = F.lit(None)
    markets = nation.select(F.explode(F.filter(F.array(
        F.when(k % 5 == 0, row(null, F.concat(F.lit("haat "), k.cast("string")),
                               F.concat(F.lit("Haat of "), name), 0)),
        F.when(k % 3 != 0, row(F.lit("rice"), F.lower(name), name, 1)),
        F.when((k % 3 == 0) & (k % 2 == 0), row(null, F.lower(name), F.concat(name, F.lit(" (other)")), 2)),
    ), lambda x: x.isNotNull())).alias("r")).select("r.*")
    varieties = nation.filter("n_nationkey < 1").select(F.explode(F.array(
        row(null, F.lit("a"), F.lit("Grade A"), 0), row(F.lit("rice"), F.lit("n"), F.lit("N"), 1))).alias("r")).select("r.*")
    return markets, varieties


_MAPPED = """
m AS (SELECT * EXCLUDE (market, variety), CASE
    WHEN lower(trim(market)) LIKE 'haat %' AND try_cast(substr(lower(trim(market)), 6) AS INTEGER) % 5 = 0
      THEN 'Haat of NATION_' || substr(lower(trim(market)), 6)
    WHEN lower(trim(market)) LIKE 'nation_%' AND k % 3 <> 0 THEN upper(trim(market))
    WHEN lower(trim(market)) LIKE 'nation_%' AND k % 2 = 0 THEN upper(trim(market)) || ' (other)'
    ELSE trim(market) END AS market,
    coalesce(CASE WHEN lower(trim(market)) LIKE 'haat %' THEN try_cast(substr(lower(trim(market)), 6) AS INTEGER) % 5 = 0
         ELSE k % 3 <> 0 OR k % 2 = 0 END, false) AS market_known,
    CASE WHEN variety = 'A' THEN 'Grade A' ELSE variety END AS variety, variety IN ('A', 'N') AS variety_known
  FROM (SELECT *, try_cast(substr(lower(trim(market)), 8) AS INTEGER) AS k FROM @typed@))"""


@query("b11_map_market_variety", f"""
WITH {_MAPPED.strip()}
SELECT market, market_known, variety, variety_known, count(*) AS n FROM m GROUP BY ALL""")
def b11(spark, folder):
    markets, varieties = _spellings(spark, folder)
    df = C.map_variety(C.map_market(A.raw_observations(spark, folder), markets), varieties)
    return df.groupBy("market", "market_known", "variety", "variety_known").agg(F.count("*").alias("n"))


_BATCH = f"""
{_MAPPED.strip()},
good AS (SELECT commodity, market, variety, reported_date, modal_price, market_known, variety_known,
           greatest(coalesce(arrivals, 0), 0) AS arrivals
         FROM m WHERE reported_date IS NOT NULL AND modal_price > 0),
final AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
            PARTITION BY commodity, market, variety, reported_date ORDER BY modal_price DESC, arrivals DESC) AS rn
          FROM good) WHERE rn = 1)"""


@query("b12_normalize_batch", f"""
WITH {_BATCH.strip()}
SELECT commodity, market, variety, reported_date, modal_price, arrivals, 'daily-file' AS source_id FROM final""")
def b12(spark, folder):
    return C.normalize_batch(A.raw_observations(spark, folder), *_spellings(spark, folder), source="daily-file")


@query("b12_batch_audit", f"""
WITH {_BATCH.strip()}
SELECT (SELECT count(*) FROM m) AS raw_rows, count(*) AS accepted,
  (SELECT count(*) FROM m WHERE reported_date IS NULL) AS rejected_dates,
  (SELECT count(*) FROM m WHERE reported_date IS NOT NULL AND NOT coalesce(modal_price > 0, false)) AS rejected_prices,
  (SELECT count(*) FROM good) - count(*) AS duplicates,
  count(DISTINCT market) FILTER (NOT market_known) AS unmapped_markets,
  count(DISTINCT variety) FILTER (NOT variety_known) AS unmapped_varieties,
  min(reported_date) AS first_date, max(reported_date) AS last_date,
  count(DISTINCT market) AS markets, count(DISTINCT variety) AS varieties FROM final""")
def b12a(spark, folder):
    return C.batch_audit(A.raw_observations(spark, folder), *_spellings(spark, folder))


@query("b12_unmapped_labels", f"""
WITH {_BATCH.strip()}
SELECT 'market' AS kind, market AS label, count(*) AS n FROM good WHERE NOT market_known GROUP BY ALL
UNION ALL SELECT 'variety', variety, count(*) FROM good WHERE NOT variety_known GROUP BY ALL""")
def b12u(spark, folder):
    return C.unmapped_labels(A.raw_observations(spark, folder), *_spellings(spark, folder))


_DISTRICT_NAMES = "'BURDWAN', 'hugli', ' Koch-Bihar ', 'none', 'Nadia', 'south 24-parganas', NULL"


@query("b13_normalize_district", f"""
WITH n AS (SELECT *, ([{_DISTRICT_NAMES}])[1 + CAST(substr(district, 8) AS INTEGER) % 7] AS spelled,
    ['Bardhaman', 'Hooghly', 'Cooch Behar', 'Unknown', 'Nadia', 'South 24 Parganas', 'Unknown'
    ][1 + CAST(substr(district, 8) AS INTEGER) % 7] AS fixed, CAST(substr(district, 8) AS INTEGER) AS k FROM @panel@)
SELECT CASE WHEN k % 4 = 0 THEN district ELSE fixed END AS district, count(*) AS n,
  ~sum(production) AS production
FROM n GROUP BY 1""")
def b13(spark, folder):
    panel = A.yield_panel(spark, folder)
    k = F.substring("district", 8, 9).cast("int")
    spelled = F.array(*[F.lit(x) for x in (
        "BURDWAN", "hugli", " Koch-Bihar ", "none", "Nadia", "south 24-parganas", None)])
    dirty = panel.withColumn("district", F.when(k % 4 == 0, F.col("district")).otherwise(spelled[k % 7]))
    return C.normalize_district(dirty).groupBy("district").agg(
        F.count("*").alias("n"), F.sum("production").alias("production"))


@query("b14_normalize_season", """
WITH n AS (SELECT *, CASE season WHEN 'Summer' THEN ([' BORO', 'rabi', 'Summer'])[1 + year % 3]
    WHEN 'Autumn' THEN (['Pre-Kharif', 'aus', 'zaid'])[1 + year % 3] ELSE (['AMAN ', 'kharif', NULL])[1 + year % 3] END AS s
  FROM @panel@)
SELECT CASE WHEN s IS NULL THEN 'Unknown' WHEN s = 'zaid' THEN 'Zaid' ELSE season END AS season, count(*) AS n,
  ~sum(area) AS area
FROM n GROUP BY 1""")
def b14(spark, folder):
    pick = lambda *v: F.array(*[F.lit(x) for x in v])[F.col("year") % 3]
    spelled = (F.when(F.col("season") == "Summer", pick(" BORO", "rabi", "Summer"))
               .when(F.col("season") == "Autumn", pick("Pre-Kharif", "aus", "zaid"))
               .otherwise(pick("AMAN ", "kharif", None)))
    return (A.yield_panel(spark, folder).select(C.normalize_season(spelled).alias("season"), "area")
            .groupBy("season").agg(F.count("*").alias("n"), F.sum("area").alias("area")))


@query("b15_normalize_text", r"""
SELECT doc_id, md5(regexp_replace(trim('  ' || replace(text, '.', '  ') || ' '), '\s+', ' ', 'g')) AS digest
FROM documents""")
def b15(spark, folder):
    docs = S.table(spark, folder, "documents")
    padded = F.concat(F.lit("  "), F.replace("text", F.lit("."), F.lit("  ")), F.lit(" "))
    return docs.select("doc_id", F.md5(C.normalize_text(padded)).alias("digest"))


_PANEL_Y = """
y AS (SELECT *, CASE WHEN area % 11 = 0 THEN 0 ELSE area END AS a,
  CASE WHEN area % 13 = 0 THEN -1 ELSE production END AS p, floor(yield_kg_ha) AS supplied FROM @panel@)"""


def _supplied(spark, folder):
    return A.yield_panel(spark, folder).select(
        "district", "season", "year",
        F.when(F.col("area") % 11 == 0, 0.0).otherwise(F.col("area")).alias("area"),
        F.when(F.col("area") % 13 == 0, -1.0).otherwise(F.col("production")).alias("production"),
        F.floor("yield_kg_ha").cast("double").alias("supplied_yield"))


@query("b16_derive_yield", f"""
WITH {_PANEL_Y.strip()}
SELECT district, season, year, a::DOUBLE AS area, supplied AS supplied_yield,
  ~p AS production,
  ~p / a * 1000 AS derived_yield,
  ~abs(p / a * 1000 - supplied) AS yield_gap
FROM y WHERE a > 0 AND p >= 0""")
def b16(spark, folder):
    return C.derive_yield(_supplied(spark, folder))


@query("b16_derive_yield_report", f"""
WITH {_PANEL_Y.strip()},
g AS (SELECT *, coalesce(a > 0 AND p >= 0, false) AS ok FROM y)
SELECT count(*) AS n_rows, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS rejected,
  ~avg(CASE WHEN ok THEN abs(p / a * 1000 - supplied) END) AS mean_gap,
  ~max(CASE WHEN ok THEN abs(p / a * 1000 - supplied) END) AS max_gap
FROM g""")
def b16r(spark, folder):
    return C.derive_yield_report(_supplied(spark, folder))


_UNITS = """
u AS (SELECT district, season, year, area, production FROM @panel@
  UNION ALL SELECT district, season, year, area, production * 100 FROM @panel@ WHERE year % 3 = 0
  UNION ALL SELECT district, season, year, area + 1, production * 100 FROM @panel@ WHERE year % 3 = 1 AND season = 'Summer'),
g AS (SELECT district, season, year, count(*) AS n, count(DISTINCT area) AS areas, count(DISTINCT production) AS productions,
    min(production) AS p_lo, max(production) AS p_hi FROM u GROUP BY ALL),
ok AS (SELECT *, n = 1 OR (areas = 1 AND productions = 2 AND p_hi = p_lo * 100) AS ok FROM g)"""


def _unit_duplicates(spark, folder):
    p = A.yield_panel(spark, folder).select("district", "season", "year", "area", "production")
    big = F.col("production") * 100
    return (p.unionByName(p.filter("year % 3 = 0").withColumn("production", big))
            .unionByName(p.filter("year % 3 = 1 AND season = 'Summer'").withColumns(
                {"production": big, "area": F.col("area") + 1})))


@query("b17_resolve_unit_duplicates", f"""
WITH {_UNITS.strip()}
SELECT district, season, year, area,
  ~production AS production
FROM (SELECT u.*, row_number() OVER (PARTITION BY district, season, year ORDER BY production, area) AS rn
      FROM u SEMI JOIN (SELECT * FROM ok WHERE ok) USING (district, season, year)) WHERE rn = 1""")
def b17(spark, folder):
    return C.resolve_unit_duplicates(_unit_duplicates(spark, folder), ["district", "season", "year"])


@query("b17_unit_duplicate_report", f"""
WITH {_UNITS.strip()}
SELECT district, season, year, n, areas, productions,
  ~p_lo AS p_lo,
  ~p_hi AS p_hi
FROM ok WHERE NOT ok""")
def b17r(spark, folder):
    return C.unit_duplicate_report(_unit_duplicates(spark, folder), ["district", "season", "year"])


@query("b18_fix_unit_scale", """
SELECT district, season, year, area, production / area * 1000 > 250000 AS unit_fixed,
  ~CASE WHEN production / area * 1000 > 250000 THEN production / 100 ELSE production END AS production,
  ~CASE WHEN production / area * 1000 > 250000 THEN production / 100 ELSE production END / area * 1000 AS yield_kg_ha
FROM @panel@""")
def b18(spark, folder):
    return C.fix_unit_scale(A.yield_panel(spark, folder), limit=250000.0)


@query("b19_harmonize_crop_units", """
WITH y AS (SELECT district, season, year, yield_kg_ha / 30000 AS yield_raw, production FROM @panel@),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY district, season, year ORDER BY yield_raw, production) AS rn FROM y)
      WHERE rn = 1)
SELECT district, season, year,
  ~yield_raw AS yield_raw,
  ~production AS production,
  ~yield_raw * CASE WHEN yield_raw < 10 THEN 1000 ELSE 10 END AS yield_kg_ha,
  ~production / CASE WHEN yield_raw < 10 THEN 1 ELSE 100 END AS production_tonnes
FROM f""")
def b19(spark, folder):
    df = A.yield_panel(spark, folder).select(
        "district", "season", "year", (F.col("yield_kg_ha") / 30000).alias("yield_raw"), "production")
    return C.harmonize_crop_units(df, "wheat", ["district", "season", "year"])


@query("b20_sanitize_weather", """
WITH s AS (SELECT district, date,
  CASE WHEN precip >= 0 THEN precip END AS precip, CASE WHEN t2m BETWEEN -50 AND 65 THEN t2m END AS t2m,
  CASE WHEN t2m_min BETWEEN -50 AND 65 THEN t2m_min END AS t2m_min,
  CASE WHEN t2m_max - 3 BETWEEN -50 AND 65 THEN t2m_max - 3 END AS t2m_max,
  CASE WHEN rh2m * 60 BETWEEN 0 AND 100 THEN rh2m * 60 END AS rh2m, CASE WHEN solar >= 0 THEN solar END AS solar,
  CASE WHEN wind >= 0 THEN wind END AS wind FROM @weather@)
SELECT district, date, coalesce(t2m_min > t2m_max, false) AS temp_order_bad,
  ~precip AS precip,
  ~t2m AS t2m,
  ~t2m_min AS t2m_min,
  ~t2m_max AS t2m_max,
  ~rh2m AS rh2m,
  ~solar AS solar,
  ~wind AS wind
FROM s""")
def b20(spark, folder):
    w = A.daily_weather(spark, folder)
    return C.sanitize_weather(w.withColumns({"t2m_max": F.col("t2m_max") - 3, "rh2m": F.col("rh2m") * 60}))


@query("b21_feature_warnings", """
SELECT district, season, year, array_to_string([x FOR x IN [
    CASE WHEN area - 25 < 0 THEN 'area is negative' END, CASE WHEN production - 3000 < 0 THEN 'precipitation is negative' END,
    CASE WHEN area / 30 < -1 OR area / 30 > 1 THEN 'ndvi outside [-1, 1]' END,
    CASE WHEN area * 2 < -20 OR area * 2 > 60 THEN 'temperature outside [-20, 60]' END,
    CASE WHEN area * 3 < 0 OR area * 3 > 100 THEN 'humidity outside [0, 100]' END] IF x IS NOT NULL], '; ') AS warnings
FROM @panel@""")
def b21(spark, folder):
    a = F.col("area")
    w = C.feature_warnings(a - 25, F.col("production") - 3000, a / 30, a * 2, a * 3)
    return A.yield_panel(spark, folder).select(
        "district", "season", "year", F.array_join(w, "; ").alias("warnings"))


def _profile_sql():
    text = ("state", "market", "variety", '"group"', "reported_date")
    nums = ("arrivals", "min_price", "max_price", "modal_price")
    parts = []
    for c in text + nums:
        v = c if c in nums else "NULL::DOUBLE"
        parts.append(f"SELECT '{c.strip(chr(34))}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS nulls, "
                     f"count(DISTINCT {c}) AS distinct_values, min({v}) AS min, max({v}) AS max, "
                     f"floor(avg({v}) * 1e4 + 0.5) / 1e4 AS mean FROM @typed@")
    return "\nUNION ALL ".join(parts)


@query("b22_profile_table", _profile_sql())
def b22(spark, folder):
    return C.profile_table(typed(spark, folder).drop("commodity", "district"))


@query("b22_duplicate_rows", """
SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM @typed@)) AS duplicates FROM @typed@""")
def b22d(spark, folder):
    return C.duplicate_rows(typed(spark, folder))


@query("b23_audit_grain", f"""
WITH p AS (SELECT *, {lag('yield_kg_ha', part='district, season', order='year')} AS yield_lag1,
    CASE WHEN area % 3 = 0 THEN NULL ELSE area END AS w1, CASE WHEN area % 5 = 0 OR area % 3 = 0 THEN NULL ELSE area END AS w2
  FROM @panel@)
SELECT count(*) AS n_rows, 0::BIGINT AS duplicate_keys, count(DISTINCT district) AS distinct_district,
  count(DISTINCT season) AS distinct_season, count(DISTINCT year) AS distinct_year, min(year) AS first_year,
  max(year) AS last_year, count(*) - count(yield_kg_ha) AS target_nulls, count(*) - count(yield_lag1) AS yield_lag1_nulls,
  count(*) FILTER (w1 IS NOT NULL AND w2 IS NOT NULL) AS weather_complete,
  count(*) FILTER (w1 IS NOT NULL AND w2 IS NULL) AS weather_incomplete,
  count(*) FILTER (w1 IS NULL AND w2 IS NULL) AS weather_missing FROM p""")
def b23(spark, folder):
    from pyspark.sql import Window
    w = Window.partitionBy("district", "season").orderBy("year")
    a = F.col("area")
    panel = A.yield_panel(spark, folder).select(
        "district", "season", "year", "yield_kg_ha", F.lag("yield_kg_ha").over(w).alias("yield_lag1"),
        F.when(a % 3 != 0, a).alias("w1"), F.when((a % 5 != 0) & (a % 3 != 0), a).alias("w2"))
    return C.audit_grain(panel, ["district", "season", "year"], "yield_kg_ha", ["yield_lag1"], ["w1", "w2"])


@query("b24_history_as_of", """
WITH h AS (SELECT commodity, market, variety, reported_date,
    CASE WHEN CAST(arrivals AS BIGINT) % 6 = 0 THEN NULL ELSE modal_price END AS p,
    CASE WHEN CAST(arrivals AS BIGINT) % 4 = 1 THEN NULL ELSE arrivals END AS a
  FROM @obs@ WHERE reported_date <= DATE '1995-10-31'),
f AS (SELECT *, count(*) OVER (PARTITION BY commodity, market, variety) AS history,
    last_value(p IGNORE NULLS) OVER b AS pb, first_value(p IGNORE NULLS) OVER f AS pf,
    last_value(a IGNORE NULLS) OVER b AS ab, first_value(a IGNORE NULLS) OVER f AS af FROM h
  WINDOW b AS (PARTITION BY commodity, market, variety ORDER BY reported_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY commodity, market, variety ORDER BY reported_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT commodity, market, variety, reported_date, coalesce(pb, pf) AS modal_price, coalesce(ab, af) AS arrivals, history
FROM f WHERE history >= 30""")
def b24(spark, folder):
    k = F.col("arrivals").cast("long")
    df = A.observations(spark, folder).select(
        *OBS_KEY, F.when(k % 6 != 0, F.col("modal_price")).alias("modal_price"),
        F.when(k % 4 != 1, F.col("arrivals")).alias("arrivals"))
    return C.history_as_of(df, "1995-10-31", 30)


@query("b25_history_eligibility", """
SELECT commodity, market, variety, reported_date, modal_price FROM (SELECT *, row_number() OVER (
  PARTITION BY commodity, market, variety ORDER BY reported_date) AS rn FROM @obs@) WHERE rn > 30""")
def b25(spark, folder):
    return C.history_eligibility(A.observations(spark, folder)).select(*OBS_KEY, "modal_price")


@query("b25_eligibility_report", """
WITH s AS (SELECT market, variety, count(*) AS n FROM @obs@ GROUP BY ALL)
SELECT count(*) AS series, count(*) FILTER (n <= 700) AS series_excluded, CAST(sum(n) AS BIGINT) AS n_rows,
  CAST(sum(greatest(n - 700, 0)) AS BIGINT) AS rows_kept, CAST(sum(n - greatest(n - 700, 0)) AS BIGINT) AS rows_excluded FROM s""")
def b25r(spark, folder):
    return C.eligibility_report(A.observations(spark, folder), 700)


@query("b26_model_ready_rows", f"""
WITH f AS (SELECT *, {lag('modal_price', 7)} AS lag_7, {strict('avg', 'modal_price', 7, -7, -1)} AS mean_7,
    CASE WHEN arrivals = 50 THEN NULL ELSE modal_price / arrivals END AS unit FROM @obs@)
SELECT market, variety, reported_date, lag_7, modal_price,
  ~mean_7 AS mean_7,
  ~unit AS unit
FROM f WHERE lag_7 IS NOT NULL AND mean_7 IS NOT NULL AND unit IS NOT NULL""")
def b26(spark, folder):
    from granary.functions.windows import full, past, series_window
    w = series_window()
    p, a = F.col("modal_price"), F.col("arrivals")
    df = A.observations(spark, folder).select(
        "market", "variety", "reported_date", "modal_price", F.lag("modal_price", 7).over(w).alias("lag_7"),
        full(F.avg("modal_price"), p, past(w, 7), 7).alias("mean_7"),
        F.when(a == 50, float("inf")).otherwise(p / a).alias("unit"))
    return C.model_ready_rows(df, ["lag_7", "mean_7", "unit"], "modal_price", ["future_price"])
