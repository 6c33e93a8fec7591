"""Readers and writers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalars import parse_dates, parse_double
from granary.schemas import (OBSERVATION_ALIASES, OBSERVATION_CONTAINS, RAW_OBSERVATION, WEATHER_COLUMNS, WEATHER_PARAMETERS,
                             WEATHER_PAYLOAD)

MISSING_WEATHER = -999.0  # fixed value


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parent_folder(path: Column, prefix: str) -> Column:
    """Name of the folder that holds a file, without the prefix if more follows it.

    Cut at the slashes: a pattern that ends at the last slash is tried from every place of the path, for every row.
    """
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    named = folder.startswith(prefix) & (F.length(folder) > len(prefix))
    return F.when(named, F.substr(folder, F.lit(len(prefix) + 1))).otherwise(folder)


def read_observations(spark: SparkSession, path: str, schema=RAW_OBSERVATION, fmt: str = "csv",
                      commodity: str | None = None) -> DataFrame:
    """All raw files below a glob as one table; the commodity is the parent folder unless given."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    df = reader.load(path)
    name = F.lit(commodity) if commodity else parent_folder(F.col("_metadata.file_path"), "commodity=")
    return df.select(name.alias("commodity"), *[F.col(f"`{c}`") for c in df.columns])


def resolve_aliases(columns: Iterable[str], aliases: Mapping[str, Sequence[str]],
                    contains: Mapping[str, Sequence[str]] | None = None) -> dict[str, str]:
    """canonical -> present column, matched without regard to case and underscores; metadata columns are ignored.

    Exact spellings go first; a column that no spelling claims may serve by what its header contains, any price
    column but minima and maxima as the last resort for the modal price.
    """
    present = {c.strip().lower().replace("_", " "): c for c in columns}
    found = {}
    for name, spellings in aliases.items():
        hit = next((present[s] for s in spellings if s in present), None)
        if hit is not None:
            found[name] = hit
    rest = {k: c for k, c in present.items() if c not in found.values() and not any(w in k for w in ("date", "min ", "max "))}
    for name, parts in (contains or {}).items():
        hit = next((rest[k] for part in parts for k in rest if part in k), None)
        if name not in found and hit is not None:
            found[name] = hit
    return found


def normalize_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]] = OBSERVATION_ALIASES,
                      keep: Sequence[str] = (), contains: Mapping[str, Sequence[str]] = OBSERVATION_CONTAINS) -> DataFrame:
    """One projection to the canonical names; columns without an alias are left out unless kept."""
    found = resolve_aliases(df.columns, aliases, contains)
    return df.select(*keep, *[F.col(f"`{src}`").alias(name) for name, src in found.items()
                              if name not in keep])


def require_columns(df: DataFrame, required: Sequence[str],
                    optional: Mapping[str, Column] | None = None) -> DataFrame:
    """Fail with the list of missing columns; create optional ones (arrivals = 0.0)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    optional = {"arrivals": F.lit(0.0)} if optional is None else optional
    return df.select("*", *[c.alias(n) for n, c in optional.items() if n not in df.columns])


def typed_observations(df: DataFrame) -> DataFrame:
    """Parse the text columns of canonical raw rows, each exactly once.

    The parsed values leave as one generated struct per row. Without that step
    the optimizer copies the parsing expressions into every later filter. The struct
    itself is made one step before: a projection evaluates common parts once and is
    compiled by pieces, a generator is not.
    """
    numbers = {"arrivals", "min_price", "max_price", "modal_price"}
    parsed = []
    for c in df.columns:
        if c in numbers:
            parsed.append(parse_double(F.col(c)).alias(c))
        elif c == "reported_date":
            parsed.append(parse_dates(F.col(c)).alias(c))
    names = {f"_parsed.{c}" for c in df.columns if c in numbers or c == "reported_date"}
    rows = df.select("*", F.struct(*parsed).alias("_made")).select("*", F.explode(F.array("_made")).alias("_parsed"))
    return rows.select(*[F.col(f"_parsed.{c}") if f"_parsed.{c}" in names else F.col(c) for c in df.columns])


def extract_subset(df: DataFrame, state: str, crop: str, state_col: str = "state",
                   crop_col: str = "group") -> DataFrame:
    """Rows whose state contains and whose crop equals the given text, ignoring case and padding."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    return df.filter(norm(state_col).contains(state.strip().lower())
                     & (norm(crop_col) == crop.strip().lower()))


def parse_weather_payload(payload: DataFrame, json_col: str = "payload",
                          district_col: str = "district") -> DataFrame:
    """Nested parameter -> yyyymmdd -> value documents to one row per (district, date)."""
    doc = F.from_json(F.col(json_col), WEATHER_PAYLOAD)
    params = payload.select(district_col, doc["properties"]["parameter"].alias("p"))
    # every parameter carries the same days; the union of keys keeps days any of them has
    days = F.array_distinct(F.flatten(F.transform(F.map_values("p"), F.map_keys)))
    rows = params.select(district_col, "p", F.explode(days).alias("ymd"))
    value = lambda name: F.try_element_at(
        F.try_element_at(F.col("p"), F.lit(name)), F.col("ymd"))
    present = lambda c: F.when(c != MISSING_WEATHER, c)
    return rows.select(
        F.col(district_col).alias("district"),
        F.try_to_timestamp("ymd", F.lit("yyyyMMdd")).cast("date").alias("date"),
        *[present(value(n)).alias(WEATHER_COLUMNS[n]) for n in WEATHER_PARAMETERS])


def read_weather_json(spark: SparkSession, path: str) -> DataFrame:
    """Weather files, one JSON document each, named after their district."""
    docs = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("district"),
        F.col("value").alias("payload"))
    return parse_weather_payload(docs)


def unpivot_wide(df: DataFrame, ids: Sequence[str], prefix: str, value: str) -> DataFrame:
    """``<prefix>_<year>_<season>`` columns to (ids, year, season, value), missing cells left out."""
    wide = [c for c in df.columns if c.startswith(prefix + "_")]
    long = df.unpivot(list(ids), wide, "_name", value)
    parts = F.split(F.col("_name"), "_")
    n = len(prefix.split("_"))
    return (long.filter(F.col(value).isNotNull())
            .select(*ids, parts[n].cast("int").alias("year"), parts[n + 1].alias("season"), value))


def write_table(df: DataFrame, path: str, partition: Sequence[str] = ("commodity",),
                fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Persist a stage; partition columns become folders, so later filters on them prune files."""
    df.write.mode(mode).partitionBy(*partition).format(fmt).save(path)
