"""Column helpers: windows per symbol, guarded rolling aggregates, ranks, parsing and mathematics."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def by_symbol(key: str = "symbol", order: str = "date"):
    return Window.partitionBy(key).orderBy(order)


def roll(agg, col: str | Column, n: int, min_periods: int | None = None, w=None) -> Column:
    """agg(col) over the last n rows; null with fewer than min_periods (default n) non-null values."""
    c = F.col(col) if isinstance(col, str) else col
    frame = (w if w is not None else by_symbol()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) >= (n if min_periods is None else min_periods), agg(c).over(frame))


def ret(col: str, n: int, w=None) -> Column:
    """Simple return over n rows."""
    w = w if w is not None else by_symbol()
    return F.try_divide(F.col(col), F.lag(col, n).over(w)) - 1


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 and the SQL define it, where Spark raises: over zero infinite with the sign of a, or NaN if that is zero too."""
    return F.when(b == 0, a * float("inf")).otherwise(a / b)


def round_to(c: Column, digits: int) -> Column:
    """A double rounded as the SQL does it, half away from zero after scaling in binary; Spark's own round goes by the decimal digits that are printed, which differs where these end in 5."""
    return F.round(c * 10.0**digits) / 10.0**digits


def median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def rank_pct(col: str, *groups: str, descending: bool = False) -> Column:
    """pandas rank(pct=True): ties get their average rank, nulls stay null and are not counted."""
    c = F.col(col)
    order = c.desc_nulls_last() if descending else c.asc_nulls_last()
    ranked, same = Window.partitionBy(*groups).orderBy(order), Window.partitionBy(*groups, col)
    alone = Window.partitionBy(*groups)
    return F.when(c.isNotNull(), (F.rank().over(ranked) + (F.count(F.lit(1)).over(same) - 1) / 2) / F.count(c).over(alone))


def avg_rank(col: str, *groups: str) -> Column:
    """Average rank of ties, from 1."""
    ranked, same = Window.partitionBy(*groups).orderBy(F.col(col)), Window.partitionBy(*groups, col)
    return F.rank().over(ranked) + (F.count(F.lit(1)).over(same) - 1) / 2


def qcut_decile(col: str, *groups: str, tie: str = "symbol", bins: int = 10) -> Column:
    """Decile 1..bins of the rank of a non-null column, as pandas qcut over first-method ranks; null with fewer than `bins` rows."""
    w, alone = Window.partitionBy(*groups).orderBy(F.col(col).asc_nulls_last(), tie), Window.partitionBy(*groups)
    n = F.count(col).over(alone)
    r = F.row_number().over(w)
    return F.when(F.col(col).isNotNull() & (n >= bins), F.greatest(F.lit(1), F.ceil((r - 1) * bins / (n - 1))).cast("int"))


def clip(c: Column, low: float, high: float) -> Column:
    """c within low and high; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def parse_ratio(kind: Column, ratio: Column) -> Column:
    """Price factor of a split `a:b` (b/a) or bonus `a:b` (b/(a+b)); null for anything else."""
    a, b = (F.get(F.split(ratio, ":"), F.lit(i)).try_cast("double") for i in (0, 1))
    return F.when((kind == "SPLIT") & (a > 0) & (b > 0), b / a).when((kind == "BONUS") & (a > 0) & (b > 0), b / (a + b))


def parse_number(text: Column, most: float = 1e9) -> Column:
    """A number from text with thousands commas, percent and currency signs; null beyond `most`."""
    cleaned = F.regexp_replace(F.trim(text), r"[,%₹$£+]|Cr", "")
    v = F.split(F.trim(cleaned), r"\s+")[0].try_cast("double")
    return F.when(F.abs(v) <= most, v)


def parse_date(text: Column, *formats: str) -> Column:
    """The date by the first format that fits; a time of day is dropped."""
    day = F.regexp_replace(F.trim(text), r"[T ]\d{2}:\d{2}.*$", "")
    return F.coalesce(*(F.try_to_date(day, f) for f in formats or ("yyyy-MM-dd", "dd-MMM-yyyy", "dd-MM-yyyy", "dd/MM/yyyy")))


def erf(x: Column) -> Column:
    """Error function by a rational approximation (absolute error below 1.5e-7)."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def norm_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / (2**0.5)))


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / ((2 * 3.141592653589793) ** 0.5)


#: Coefficients of a rational approximation of the inverse normal distribution (fixed values; relative error below 1.2e-9).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
PPF_TAIL = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + c
    return total


def norm_ppf(p: Column) -> Column:
    """Inverse of the normal distribution function; null outside (0, 1)."""
    near = F.least(p, 1 - p)
    q, tail = p - 0.5, F.sqrt(-2 * F.ln(near))
    middle = _horner(PPF_A, q * q) * q / _horner(PPF_B, q * q)
    outer = _horner(PPF_C, tail) / _horner(PPF_D, tail)
    return F.when((p > 0) & (p < 1), F.when(near >= PPF_TAIL, middle).when(p < 0.5, outer).otherwise(-outer))
