"""Numbers, units, confidence and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NUMBER, _c, norm_text

DECIMAL = "decimal(38,10)"
#: Words of a unit in the order in which they are tried, with unit, currency and scale: fixed values.
UNITS = (("亿美元", "USD", "USD", "100000000"), ("亿元", "CNY", "CNY", "100000000"), ("百万元", "CNY", "CNY", "1000000"), ("万元", "CNY", "CNY", "10000"), ("元/股", "CNY/share", "CNY", "1"), ("元／股", "CNY/share", "CNY", "1"))
MULTIPLES = ("市盈率", "市销率", "市净率", "EV/EBIT", "EV/EBITDA")


def decimal_or_null(x: Column | str) -> Column:
    """A decimal without grouping commas; null for null, blank and the words null and none."""
    text = F.replace(F.trim(_c(x).cast("string")), F.lit(","), F.lit(""))
    return F.when(~F.lower(text).isin("", "null", "none"), text.try_cast(DECIMAL))


def is_decimal(x: Column | str) -> Column:
    text = F.trim(_c(x).cast("string"))
    return _c(x).isNull() | F.lower(text).isin("", "null", "none") | decimal_or_null(x).isNotNull()


def canonical_value(kind, raw, normalized, low, high, scale) -> Column:
    """Struct of kind, raw, normalized, range_low, range_high, scale and reject_reason (null if the value stands)."""
    kind, text = F.lower(F.coalesce(F.nullif(_c(kind), F.lit("")), F.lit("scalar"))), norm_text(F.coalesce(_c(raw), F.lit("")))
    literal = F.regexp_extract(text, NUMBER, 0)
    bad = [
        (~kind.isin("scalar", "range", "text") | (text == ""), "invalid value kind or empty raw value"),
        (~(is_decimal(normalized) & is_decimal(low) & is_decimal(high)), "invalid normalized decimal"),
        ((kind == "scalar") & decimal_or_null(normalized).isNull(), "scalar value requires normalized_decimal"),
        ((kind == "range") & (decimal_or_null(low).isNull() | decimal_or_null(high).isNull()), "range value requires range_low and range_high"),
        (~is_decimal(scale), "invalid scale"),
        ((kind == "scalar") & (literal == ""), "scalar raw value has no numeric literal"),
    ]
    reason = F.coalesce(*[F.when(c, F.lit(m)) for c, m in bad])
    number = F.when(kind == "scalar", decimal_or_null(literal)).otherwise(decimal_or_null(normalized))
    return F.struct(kind.alias("kind"), text.alias("raw"), number.alias("normalized"), decimal_or_null(low).alias("range_low"), decimal_or_null(high).alias("range_high"), decimal_or_null(scale).alias("scale"), reason.alias("reject_reason"))


def value_unit(raw, corpus, unit=None) -> Column:
    """Struct (unit, currency, scale) by the first rule that holds; null if none does."""
    raw, packed = _c(raw), F.regexp_replace(F.concat(_c(raw), F.lit(" "), _c(corpus)), r"(?U)\s+", "")
    out = lambda u, c, s: F.struct(F.lit(u).alias("unit"), F.lit(c).cast("string").alias("currency"), F.lit(s).alias("scale"))
    percent = raw.contains("%") if unit is None else raw.contains("%") | (_c(unit) == "percent")
    case = F.when(percent, out("percent", None, "0.01"))
    for word, u, c, s in UNITS:
        case = case.when(packed.contains(word), out(u, c, s))
    return case.when(F.lower(raw).contains("gb"), out("GB", None, "1"))


def table_unit(metric, raws) -> Column:
    """Struct (unit, currency, scale) of a table row from its metric and raw cells."""
    metric = _c(metric)
    out = lambda u, c, s: F.struct(F.lit(u).alias("unit"), F.lit(c).cast("string").alias("currency"), F.lit(s).alias("scale"))
    return F.when(F.exists(_c(raws), lambda r: r.endswith("%")), out("percent", None, "0.01")).when(metric.startswith("每股"), out("CNY/share", "CNY", "1")).when(metric.isin(*MULTIPLES), out("multiple", None, "1")).when(metric.rlike("比率|周转率|ROE|ROIC"), out("ratio", None, "1")).otherwise(out("CNY", "CNY", "1000000"))


def value_errors(kind, normalized, low, high, scale) -> Column:
    """Array of the codes DATA_RANGE, DATA_VALUE_KIND, DATA_DECIMAL that a stored value earns."""
    kind = _c(kind)
    n, lo, hi = (decimal_or_null(x) for x in (normalized, low, high))
    bad = (kind == "scalar") & n.isNull() | (kind == "range") & (lo.isNull() | hi.isNull()) | ~is_decimal(scale)
    return F.array_compact(F.array(F.when((kind == "range") & (lo > hi), F.lit("DATA_RANGE")), F.when(~kind.isin("scalar", "range", "text"), F.lit("DATA_VALUE_KIND")), F.when(bad, F.lit("DATA_DECIMAL"))))


def base_value(scale, normalized) -> Column:
    """Scale times number."""
    return decimal_or_null(scale).cast("decimal(28,10)") * decimal_or_null(normalized).cast("decimal(28,10)")


def confidence(json: Column | str) -> Column:
    """The number if the JSON text is a number from 0 to 1, else null; strings, booleans and NaN are not coerced."""
    text = F.trim(_c(json))
    number = F.when(text.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?$"), text.try_cast("double"))
    return F.when(number.between(0, 1), number)


def half_even(x: Column, places: int = 2) -> Column:
    return F.bround(x, places)


def clamp(x: Column | str) -> Column:
    """N06."""
    return F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0))


def rounded(x: Column, places: int = 2) -> Column:
    """A double rounded half away from zero after it is scaled in double precision, as SQL's round does."""
    return F.round(x * 10.0**places) / 10.0**places


def half_even_double(x: Column, places: int = 2) -> Column:
    """A double rounded half even after it is scaled in double precision, as SQL's round_even does."""
    return F.rint(x * 10.0**places) / 10.0**places


def display_number(value, unit, double: bool = False) -> Column:
    """T17. double: quotients are doubles, as in SQL, so that a tie such as 150.015 may fall to either side; else exact decimals."""
    v, u = _c(value).cast(DECIMAL), _c(unit)
    two = lambda x: F.bround(x, 2).cast("decimal(38,2)").cast("string")
    over = lambda n: half_even_double(v.cast("double") / n).cast("decimal(38,2)").cast("string") if double else two(v / n)
    cny = F.when(F.abs(v) >= 100000000, F.concat(over(100000000), F.lit("亿元"))).when(F.abs(v) >= 10000, F.concat(over(10000), F.lit("万元"))).otherwise(F.concat(two(v), F.lit("元")))
    return F.when(u == "CNY", cny).when(u == "CNY/share", F.concat(two(v), F.lit("元/股"))).when(u == "%", F.concat(two(v), F.lit("%"))).otherwise(F.concat(_c(value).cast("string"), u))


def shanghai_date(ms: Column | str) -> Column:
    """The Shanghai day of an instant in epoch milliseconds (session time zone UTC)."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(_c(ms).cast("long")), "Asia/Shanghai"))


def within(published: Column | str, as_of: str) -> Column:
    """Published on the day as_of or before it."""
    return F.to_date(_c(published)) <= F.lit(as_of).cast("date")


def window_start(year: Column | str) -> Column:
    """1 January four years back, 2000 at the earliest."""
    return F.make_date(F.greatest(F.lit(2000), _c(year) - 4), F.lit(1), F.lit(1))
