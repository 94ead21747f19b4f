"""Column helpers for the places where plain Spark functions would mislead:
NULL-skipping greatest/least, NaN ordering and ANSI division."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelrisk.fixed_values import EPS, HORIZON


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c) -> Column:
    return F.nanvl(as_col(c).cast("double"), F.lit(None).cast("double"))


def zero(c) -> Column:
    """NULL and NaN become 0.0."""
    return F.coalesce(null_if_nan(c), F.lit(0.0))


def clip(c, low, high) -> Column:
    """Bound to [low, high]; NULL stays NULL."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def safe_div(a, b, eps=None) -> Column:
    """a / (|b| + eps), or NULL on a zero divisor when no eps is given."""
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    return F.try_divide(a, b) if eps is None else a / (F.abs(b) + F.lit(eps))


def relative_gap(short, long, eps=EPS) -> Column:
    """(short - long) / (|long| + eps)."""
    return safe_div(as_col(short) - as_col(long), long, eps)


def number(c) -> Column:
    """Tolerant numeric parse; text that is no number, and NaN, become NULL."""
    return null_if_nan(as_col(c).try_cast("double"))


def non_negative(c) -> Column:
    """Tolerant numeric parse, negatives to 0, NULL to 0."""
    return F.greatest(F.coalesce(number(c), F.lit(0.0)), F.lit(0.0))


def flag(condition) -> Column:
    """1 where the condition holds, else 0 (NULL counts as not)."""
    return F.when(condition, 1).otherwise(0)


def anocracy(democracy, bounded=False) -> Column:
    d = clip(democracy, 0.0, 1.0) if bounded else as_col(democracy)
    return F.lit(4.0) * d * (F.lit(1.0) - d)


def log_count(c) -> Column:
    """log(1 + x) of a count column, kept as double; unparsable text is NULL."""
    return F.log1p(number(c))


def year_of_text(c) -> Column:
    """Year from the first four characters of a week label, date text or YYYYMMDD number."""
    return F.substring(as_col(c).cast("string"), 1, 4).try_cast("int")


def grid_cell(c, digits=2) -> Column:
    """Value rounded half away from zero to ``digits`` decimals, as a whole number of cells.

    Plain arithmetic: cheaper than a decimal rounding per row.
    """
    c = as_col(c).cast("double")
    return (F.signum(c) * F.floor(F.abs(c) * 10 ** digits + 0.5)).cast("long")


def day_number(time) -> Column:
    """Date as the number YYYYMMDD."""
    d = F.to_date(as_col(time))
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def week_label(iso_year, week) -> Column:
    return F.concat(as_col(iso_year).cast("string"), F.lit("-"),
                    F.lpad(as_col(week).cast("string"), 2, "0"))


def iso_year(day) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), as_col(day)).cast("int")


def iso_week(day) -> Column:
    return F.weekofyear(as_col(day))


def week_monday(week_id) -> Column:
    """Monday of a ``YYYY-WW`` label."""
    w = as_col(week_id)
    first = F.trunc(F.make_date(F.substring(w, 1, 4).cast("int"), F.lit(1), F.lit(4)), "week")
    return F.date_add(first, (F.substring(w, 6, 2).cast("int") - 1) * 7)


def target_week(week_end, weeks=HORIZON) -> Column:
    """Date text a number of weeks after a window end (a date or ``YYYY-WW`` label)."""
    w = as_col(week_end)
    text = w.cast("string")
    start = F.when(F.length(text) <= 7, week_monday(text)).otherwise(text.try_cast("date"))
    return F.date_format(F.date_add(start, 7 * weeks), "yyyy-MM-dd")


def active_month_of_week(week) -> Column:
    """Approximate month of a week number (4.33 weeks a month), never above 12."""
    return F.least(F.lit(12), F.ceil(as_col(week).cast("double") / F.lit(4.33)).cast("int"))
