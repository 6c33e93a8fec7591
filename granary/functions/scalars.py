"""Scalar expressions: parsing, rounding, ids, targets, probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal number. Sentinels such as "N/A", "nan", "inf", "?" or "-" do not fit.
NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"

# Spellings of a date that are brought to year-month-day; slash, dot and dash dates are day first. Fixed values.
TIME_OF_DAY = r"[T ]+([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?\s*(Z|[AaPp][Mm]|[-+]\d{2}:?\d{2})?$"
DATE_SHAPES = (
    (r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4}|\d{2})$", "$3-$2-$1"),
    (r"^(\d{1,2})[- /]?([A-Za-z]{3,9})\.?,?[- /]?(\d{4}|\d{2})$", "$3-$2-$1"),
    (r"^([A-Za-z]{3,9})\.?[- ](\d{1,2}),?[- ](\d{4})$", "$3-$1-$2"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
YEAR_MONTH_DAY = r"^(\d{4}|\d{2})[-/.]([A-Za-z]{3,9}|\d{1,2})[-/.]\d{1,2}$"
#: The usual spellings, digits written as 0: year first, day first. Fixed values.
YEAR_FIRST = ("0000-00-00", "0000/00/00", "0000.00.00")
DAY_FIRST = ("00-00-0000", "00/00/0000", "00.00.0000", "00 00 0000")
#: Two-digit years from this one on are of the last century.
PIVOT_YEAR = 69


def parse_dates(col: Column) -> Column:
    """Date of a text in any usual spelling, with or without a time of day, else NULL.

    The usual shapes, ten characters with all digits in place, are cut at fixed places; only texts of another shape
    meet the patterns. A date that does not exist is NULL.
    """
    plain = F.trim(col.cast("string"))
    shape = F.translate(plain, "123456789", "000000000")

    number = lambda at, n: F.substring(plain, at, n).cast("int")

    def cut(year: int, month: Column, day: int) -> Column:
        zero = F.lit(0)
        return F.try_make_timestamp(number(year, 4), month, number(day, 2), zero, zero, zero.cast("decimal(16,6)")).cast("date")
    # day, a short month name, year: the name's place in the list of all names
    name = F.call_function("locate", F.lower(F.substring(plain, 4, 3)), F.lit("".join(m[:3] for m in MONTHS)))
    named = ((F.length(shape) == 11) & (F.substring(shape, 1, 2) == "00") & (F.substring(shape, 8, 4) == "0000") & (name % 3 == 1)
             & F.substring(shape, 3, 1).isin(" ", "-", "/") & F.substring(shape, 7, 1).isin(" ", "-", "/"))
    return (F.when(shape.isin(*YEAR_FIRST), cut(1, number(6, 2), 9)).when(shape.isin(*DAY_FIRST), cut(7, number(4, 2), 1))
            .when(named, cut(8, F.floor((name + 2) / 3).cast("int"), 1)).otherwise(_unusual_date(plain)))


def _unusual_date(plain: Column) -> Column:
    """Date of a trimmed text with names of months, short numbers or a time of day."""
    text = F.regexp_replace(plain, TIME_OF_DAY, "")
    for shape, order in DATE_SHAPES:
        text = F.regexp_replace(text, shape, order)
    names = [(name, i) for i, full in enumerate(MONTHS, 1) for name in dict.fromkeys((full, full[:3]))] + [("sept", 9)]
    numbers = F.create_map(*(F.lit(x) for pair in names for x in (pair[0], str(pair[1]))))

    def date(parts: Column) -> Column:
        year, month, day = (F.get(parts, F.lit(i)) for i in range(3))
        month = F.coalesce(F.try_element_at(numbers, F.lower(month)), month)
        year = F.concat(F.when(F.length(year) == 4, "").when(year >= str(PIVOT_YEAR), "19").otherwise("20"), year)
        return F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("y-M-d")).cast("date")
    # a text of another shape gives no parts; the lambda's argument keeps the steps before it from being repeated
    parts = F.regexp_extract_all(text, F.lit(YEAR_MONTH_DAY), F.lit(0))
    fields = F.transform(parts, lambda t: F.split(t, "[-/.]"))
    return F.get(F.transform(fields, date), F.lit(0))


def finite(col: Column) -> Column:
    """NaN and infinities become NULL."""
    bad = F.isnan(col) | (F.abs(col) == float("inf"))
    return F.when(~bad, col)


def parse_double(col: Column) -> Column:
    """Lenient number parsing; anything that is no finite number becomes NULL."""
    text = F.trim(col.cast("string"))
    return finite(F.when(text.rlike(NUMBER), text).try_cast("double"))


def positive(col: Column) -> Column:
    return F.when(col > 0, col)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is 0."""
    return F.try_divide(num, den)


def clip(col: Column, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def zero_if_missing(col: Column) -> Column:
    return F.coalesce(finite(col), F.lit(0.0))


def squash_space(col: Column) -> Column:
    """Trim and collapse runs of white space."""
    return F.regexp_replace(F.trim(col), r"\s+", " ")


def round_half_up(col: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same double arithmetic in every SQL engine."""
    scale = float(10 ** digits)
    return F.floor(col * scale + 0.5).cast("double") / scale


# --- forecast ids -----------------------------------------------------------

def hash_id(parts: Sequence[Column], sep: str = "|", length: int = 64) -> Column:
    """SHA-256 over the lower-cased, trimmed parts, cut to ``length`` hex digits."""
    key = F.concat_ws(sep, *[F.lower(F.trim(p.cast("string"))) for p in parts])
    return F.substring(F.sha2(key, 256), 1, length)


def price_forecast_id(market: Column, variety: Column, origin: Column, horizon: Column,
                      model: Column) -> Column:
    return hash_id([market, variety, F.date_format(origin, "yyyy-MM-dd"), horizon, model], length=16)


def volatility_forecast_id(commodity: Column, market: Column, variety: Column, origin: Column,
                           horizon: Column, model: Column) -> Column:
    return hash_id([commodity, market, variety, F.date_format(origin, "yyyy-MM-dd"), horizon, model])


def yield_forecast_id(crop: Column, district: Column, year: Column, stamp: Column) -> Column:
    """Readable prefix crop_district_year plus 12 hex digits."""
    prefix = [F.regexp_replace(F.lower(F.trim(p.cast("string"))), r"\s+", "_")
              for p in (crop, district, year)]
    digest = hash_id([crop, district, year, stamp], length=12)
    return F.concat_ws("_", *prefix, digest)


# --- changes ----------------------------------------------------------------

def pct_change(now: Column, then: Column) -> Column:
    return ratio(now - then, then) * 100.0


def log_return(now: Column, then: Column) -> Column:
    return F.when((now > 0) & (then > 0), F.ln(ratio(now, then)))


def spread_pct(low: Column, high: Column, modal: Column) -> Column:
    """(max - min) as % of the modal price."""
    return ratio(high - low, modal) * 100.0


def position_in_range(low: Column, high: Column, modal: Column) -> Column:
    """Where the modal price lies between min and max; 0.5 when the range is empty or unknown."""
    return F.coalesce(F.when(high > low, (modal - low) / (high - low)), F.lit(0.5))


# --- classes and probabilities ---------------------------------------------

CLASSES = ("LOW", "MEDIUM", "HIGH")


def classify3(x: Column, low, high) -> Column:
    """Right-closed bins; NULL stays NULL."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return (F.when(x.isNull() | low.isNull() | high.isNull(), F.lit(None).cast("string"))
            .when(x <= low, "LOW").when(x <= high, "MEDIUM").otherwise("HIGH"))


def movement_class(abs_pct: Column) -> Column:
    """Realised movement class with the fixed bounds 2 % and 6 %."""
    return classify3(abs_pct, 2.0, 6.0)


def class_code(label: Column) -> Column:
    return F.when(label == "LOW", 0).when(label == "MEDIUM", 1).when(label == "HIGH", 2)


def probabilities_valid(ps: Sequence[Column], tolerance: float = 1e-4) -> Column:
    """All in [0, 1] and summing to 1 within the tolerance; NULL counts as invalid."""
    in_bounds = [(p >= 0) & (p <= 1) for p in ps]
    total = sum(ps[1:], ps[0])
    ok = F.abs(total - 1.0) <= tolerance
    for b in in_bounds:
        ok = ok & b
    return F.coalesce(ok, F.lit(False))


def normalized(ps: Sequence[Column]) -> list[Column]:
    """Each probability divided by the sum; NULL when the sum is 0."""
    total = sum(ps[1:], ps[0])
    return [ratio(p, total) for p in ps]


# --- yields -----------------------------------------------------------------

def production_tonnes(yield_t_ha: Column, area_ha: Column) -> Column:
    """Tonnes on a positive area, else NULL."""
    return F.when(area_ha > 0, yield_t_ha * area_ha)
