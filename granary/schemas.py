"""Canonical schemas."""

from pyspark.sql import types as T

SERIES = ("commodity", "market", "variety")
OBS_KEY = SERIES + ("reported_date",)

OBSERVATION = T.StructType([
    T.StructField("commodity", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("variety", T.StringType()),
    T.StructField("reported_date", T.DateType()),
    T.StructField("min_price", T.DoubleType()),
    T.StructField("max_price", T.DoubleType()),
    T.StructField("modal_price", T.DoubleType()),
    T.StructField("arrivals", T.DoubleType()),
])

# Text columns of a raw market file, in file order.
RAW_OBSERVATION = T.StructType([
    T.StructField(name, T.StringType()) for name in (
        "State Name", "District Name", "Market Name", "Variety", "Group", "Arrivals (Tonnes)",
        "Min Price (Rs./Quintal)", "Max Price (Rs./Quintal)", "Modal Price (Rs./Quintal)",
        "Reported Date")
])

WEATHER_PARAMETERS = (
    "PRECTOTCORR", "T2M", "T2M_MIN", "T2M_MAX", "RH2M", "ALLSKY_SFC_SW_DWN", "WS2M")

# parameter name in weather payloads -> column name used here
WEATHER_COLUMNS = {
    "PRECTOTCORR": "precip",
    "T2M": "t2m",
    "T2M_MIN": "t2m_min",
    "T2M_MAX": "t2m_max",
    "RH2M": "rh2m",
    "ALLSKY_SFC_SW_DWN": "solar",
    "WS2M": "wind",
}

WEATHER_PAYLOAD = T.StructType([
    T.StructField("properties", T.StructType([
        T.StructField("parameter", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
    ])),
])

# Header spellings, compared in lower case with blanks for underscores; then texts that a header has to contain, for
# columns that no spelling has named. Fixed values.
OBSERVATION_CONTAINS = {"modal_price": ("modal price", "modalprice", "price"), "arrivals": ("arrivals", "arrival", "volume")}
OBSERVATION_ALIASES = {
    "state": ("state", "state name"),
    "district": ("district", "district name"),
    "market": ("market", "market name", "mandi"),
    "variety": ("variety", "variety name", "commodity variety", "crop variety"),
    "group": ("group", "commodity group"),
    "arrivals": ("arrivals", "arrivals (tonnes)", "arrivals tonnes", "arrival quantity"),
    "min_price": ("min price", "min price (rs./quintal)"),
    "max_price": ("max price", "max price (rs./quintal)"),
    "modal_price": ("modal price", "modal price (rs./quintal)", "modal price rs quintal", "price"),
    "reported_date": ("reported date", "date", "arrival date", "report date"),
}
