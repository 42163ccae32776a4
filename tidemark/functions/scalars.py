"""Scalar and window helpers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Denominators up to this size count as zero.
EPSILON = 1e-9
SERIES = ("symbol", "tf")
#: Milliseconds of each interval name; a month counts 30 days.
INTERVAL_MS = {"1m": 60_000, "3m": 180_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "2h": 7_200_000, "4h": 14_400_000, "6h": 21_600_000, "8h": 28_800_000, "12h": 43_200_000, "1d": 86_400_000, "3d": 259_200_000, "1w": 604_800_000, "1M": 2_592_000_000}


def safe_divide(n: Column, d: Column, default: float | Column = 0.0) -> Column:
    return F.when(F.abs(d) > EPSILON, n / d).otherwise(default)


def exact_sum(x: Column, total: Callable[[Column], Column] = F.sum) -> Column:
    """Sum of doubles up to 1e23, rounded once, in whatever order the rows come: whole multiples of 2^-16 add up without error, and the rests are too small for theirs to show. NaN where one isn't finite. ``total`` sums a column, and may be over a window."""
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    finite = F.when(~odd, x)
    whole = (finite * 65536).cast("decimal(28,0)")
    made = total(whole).cast("double") / 65536 + total(finite - whole.cast("double") / 65536)
    return F.when(total(odd.cast("int")) > 0, F.lit(float("nan"))).otherwise(made)


def place(ts: Column, number: Column) -> Column:
    """Time and number (64 bits; nulls before all) as one, for min_by and max_by: by a struct, their aggregate sorts all rows of its task, by this it keeps a row a group."""
    at, of = (F.coalesce(x, F.lit(-(2**62))).cast("decimal(38,0)") for x in (F.unix_micros(ts), number.cast("long")))
    return at * F.lit(str(2**64)).cast("decimal(20,0)") + of


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def ladder(*rungs: tuple[Column, object], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in rungs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def series(keys: tuple[str, ...] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ts", "seq")


def last_rows(n: int, end: int = 0) -> WindowSpec:
    """The n rows that end ``end`` rows before the current one (end <= 0)."""
    return series().rowsBetween(end - n + 1, end)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lag(name: str | Column, k: int = 1) -> Column:
    return F.lag(name, k).over(series())


def full(value: Column, window: WindowSpec, n: int) -> Column:
    """``value`` over a window of n rows, null while it isn't full."""
    return F.when(F.count(F.lit(1)).over(window) == n, value)


def true_range() -> Column:
    """The first bar's is high - low: greatest() passes over nulls."""
    previous = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))


def interval_ms(tf: Column) -> Column:
    """Unknown names count as one minute."""
    known = F.create_map(*[F.lit(x) for k, v in INTERVAL_MS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(known, tf), F.lit(60_000))


#: The interval above each, for context.
ABOVE = {"1m": "5m", "3m": "15m", "5m": "15m", "15m": "1h", "30m": "2h", "1h": "4h", "2h": "4h", "4h": "1d", "6h": "1d", "8h": "1d", "12h": "1d", "1d": "1w", "3d": "1w", "1w": "1M"}


def higher_interval(tf: Column) -> Column:
    """The interval that gives ``tf`` its context; null for unknown ones and the longest."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ABOVE.items() for x in pair]), tf)


def history_limit(wanted: Column, available: Column, default: int = 30) -> Column:
    """Rows to look back: ``wanted`` (``default`` where null or not positive), two at least and no more than there are."""
    asked = F.when(wanted > 0, wanted).otherwise(default)
    return F.when(available < 2, available).otherwise(F.greatest(F.lit(2), F.least(asked, available)))


def bias_way(bias: Column) -> Column:
    """1 for BULL and -1 for BEAR in any case of letters, else 0."""
    return ladder((F.upper(bias) == "BULL", 1), (F.upper(bias) == "BEAR", -1), otherwise=0)


def normalized_symbol(symbol: Column) -> Column:
    return F.upper(F.regexp_replace(symbol, "[/_-]", ""))


def annualized_funding(rate: Column) -> Column:
    """Three payments a day, in per cent."""
    return rate * 1095 * 100
