"""Row-level cleaning and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeworks import constants as K


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column | str, lo, hi) -> Column:
    """Clip that keeps nulls: greatest/least alone would skip them."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def finite(x: Column | str) -> Column:
    """Number or null: text that does not parse, NaN and infinities become null."""
    v = col(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def first_nonzero(*xs: Column | str) -> Column:
    """First value that is neither null nor zero."""
    return F.coalesce(*[F.nullif(col(x), F.lit(0)) for x in xs])


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clean_ticker(x: Column | str) -> Column:
    return F.upper(F.trim(col(x)))


def valid_ticker(x: Column | str) -> Column:
    return clean_ticker(x).rlike(K.TICKER_PATTERN)


def market_of(ticker: Column | str) -> Column:
    t = F.upper(col(ticker))
    return F.when(t.endswith(".L"), "UK").when(t.endswith(".IR"), "IE").otherwise("US")


def is_us(ticker: Column | str) -> Column:
    return market_of(ticker) == "US"


def log_market_cap(cap: Column | str) -> Column:
    return F.ln(F.greatest(F.coalesce(finite(cap), F.lit(0.0)), F.lit(1e6)))


def analyst_consensus(buy, hold, sell) -> Column:
    b, h, s = [F.coalesce(col(x), F.lit(0)) for x in (buy, hold, sell)]
    total = b + h + s
    return F.when(total >= 3, (b - s) / total)


def confidence_band(score: Column | str) -> Column:
    score = col(score)
    out = None
    for name, floor in K.BANDS[:-1]:
        out = F.when(score >= floor, name) if out is None else out.when(score >= floor, name)
    return out.otherwise(K.BANDS[-1][0])


def sector_of(raw: Column | str, ticker: Column | None = None, known: dict[str, str] | None = None) -> Column:
    """Canonical sector: known ticker, exact name, first keyword, else Unknown."""
    s = F.lower(F.trim(col(raw)))
    exact = F.create_map(*[F.lit(v) for kv in K.EXACT_SECTORS.items() for v in kv])
    out = F.when(s.isNull() | (s == ""), F.lit("Unknown"))
    out = out.when(F.try_element_at(exact, s).isNotNull(), F.try_element_at(exact, s))
    for word, sector in K.SECTOR_KEYWORDS:
        out = out.when(s.contains(word), sector)
    out = out.otherwise("Unknown")
    if known and ticker is not None:
        named = F.create_map(*[F.lit(v) for kv in known.items() for v in kv])
        out = F.coalesce(F.try_element_at(named, F.upper(ticker)), out)
    return out


def sector_benchmark(raw: Column | str) -> Column:
    """Benchmark symbol of an industry string: exact, else contains either way."""
    raw = col(raw)
    low = F.lower(raw)
    out = F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string"))
    for name, symbol in K.SECTOR_BENCHMARKS.items():
        out = out.when(raw == name, symbol)
    for name, symbol in K.SECTOR_BENCHMARKS.items():
        key = name.lower()
        out = out.when(low.contains(key) | F.lit(key).contains(low), symbol)
    return out


def rounded(x: Column | str, digits: int = 2) -> Column:
    return F.bround(finite(x), digits)


def percent(x: Column | str, digits: int = 1) -> Column:
    return F.bround(finite(x) * 100, digits)


def month_span(start: Column, end: Column) -> Column:
    return F.concat_ws(" → ", F.date_format(start, "MMM yyyy"), F.date_format(end, "MMM yyyy"))


def day_label(d: Column | str) -> Column:
    return F.date_format(col(d), "dd MMM yyyy")


def model_version(trained_at: Column | str, encoder: Column | str | None = None) -> Column:
    """Training time, with the encoder version when there is one, at most 128 long."""
    base = F.coalesce(col(trained_at).cast("string"), F.lit("untrained"))
    if encoder is not None:
        base = F.concat(base, F.coalesce(F.concat(F.lit("+enc:"), col(encoder)), F.lit("")))
    return F.substring(base, 1, 128)
