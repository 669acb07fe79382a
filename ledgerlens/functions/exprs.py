"""Column expressions that reproduce the reports' scalar semantics.

Everything here is a built-in Spark expression (no Python UDF), so it stays
inside whole-stage code generation. The helpers encode three families of
rules: PostgreSQL arithmetic (``round`` half away from zero, ``date - date``
as days, ``date_trunc`` on dates), JavaScript post-processing (``Math.round``,
``parseFloat(v) || 0``, ``v || null``, ``String.prototype.trim``) and the
report vocabulary (delivery stages, aging buckets, ``Xh Ym`` durations).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reports' vocabulary.
OPEN_PAYMENT_STATUSES = ("Unpaid", "Partially Paid")
PACKED_STATUSES = ("packed",)
SHIPPED_STATUSES = ("shipped", "in_transit")
DELIVERED_STATUSES = ("delivered", "fully_delivered", "partially_delivered")
# Display status per lower-cased raw status; anything else is shown raw.
STATUS_DISPLAY = {
    "pending": "Pending",
    "packed": "Packed",
    "shipped": "Shipped",
    "in_transit": "Shipped",
    "delivered": "Delivered",
    "fully_delivered": "Delivered",
    "partially_delivered": "Delivered",
}
# Board sort rank per lower-cased raw status (NULL counts as 'pending';
# statuses not listed rank 0).
STATUS_RANK = {
    "pending": 0,
    "packed": 1,
    "shipped": 2,
    "delivered": 3,
    "fully_delivered": 3,
    "partially_delivered": 3,
}
AGING_BUCKETS = ((30, "0-30"), (60, "31-60"), (90, "61-90"))
AGING_OVERFLOW = "90+"
# Characters removed by String.prototype.trim: ECMAScript WhiteSpace
# (TAB, VT, FF, SP, NBSP, ZWNBSP and the Unicode Zs category) plus
# LineTerminator (LF, CR, LS, PS).
JS_TRIM_CLASS = "[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
# ---------------------------------------------------------------------------

_US_PER_MINUTE = 60_000_000


def as_date(value) -> Column:
    """A Python date / ISO string / Column as a DATE column; None is today
    (the session's ``current_date()``)."""
    if value is None:
        return F.current_date()
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, _dt.datetime):
        value = value.date()
    if isinstance(value, str):
        value = _dt.date.fromisoformat(value)
    if not isinstance(value, _dt.date):
        raise TypeError(f"expected a date, got {value!r}")
    return F.lit(value)


def money(c: Column) -> Column:
    """Decimal amount as it leaves the API: a double (``parseFloat``)."""
    return c.cast("double")


def money_or_zero(c: Column) -> Column:
    """``parseFloat(v) || 0``: NULL and NaN become 0."""
    d = c.cast("double")
    return F.coalesce(F.nanvl(d, F.lit(0.0)), F.lit(0.0))


def count_or_zero(c: Column) -> Column:
    """``parseInt(v) || 0`` on a count."""
    return F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))


def blank_to_null(c: Column) -> Column:
    """``v || null`` on a string: '' becomes NULL."""
    return F.nullif(c, F.lit(""))


def js_round(c: Column) -> Column:
    """``Math.round``: nearest integer, ties toward +infinity."""
    return F.floor(c.cast("double") + F.lit(0.5))


def pg_round(c: Column) -> Column:
    """PostgreSQL ``round(numeric)::int``: half away from zero, as BIGINT."""
    return F.round(c, 0).cast("bigint")


def days_between(later: Column, earlier: Column) -> Column:
    """PostgreSQL ``date - date``: whole days as an integer."""
    return F.datediff(later, earlier)


def trunc_date(unit: str, d: Column) -> Column:
    """``DATE_TRUNC(unit, date)::date`` for unit day / week (Monday) / month."""
    if unit not in ("day", "week", "month"):
        raise ValueError(f"unsupported unit {unit!r}")
    return F.to_date(F.date_trunc(unit, d))


def local_wall_clock(ts: Column, tz: str) -> Column:
    """``ts AT TIME ZONE tz`` as a zone-less timestamp (session-zone free)."""
    return F.convert_timezone(None, F.lit(tz), ts)


def local_midnight(d: Column, tz: str) -> Column:
    """The instant at which local day ``d`` starts in zone ``tz``."""
    z = F.lit(0)
    return F.make_timestamp(F.year(d), F.month(d), F.dayofmonth(d), z, z, z, F.lit(tz))


def local_date(ts: Column, tz: str) -> Column:
    return F.to_date(local_wall_clock(ts, tz))


def local_hour(ts: Column, tz: str) -> Column:
    return F.hour(local_wall_clock(ts, tz))


def is_open_invoice(payment_status: Column | None = None) -> Column:
    c = F.col("payment_status") if payment_status is None else payment_status
    return c.isin(*OPEN_PAYMENT_STATUSES)


def status_in(status: Column, values) -> Column:
    """``LOWER(status) IN (...)`` — NULL stays NULL (three-valued)."""
    return F.lower(status).isin(*values)


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{JS_TRIM_CLASS}+|{JS_TRIM_CLASS}+$", "")


def normalize_status(raw: Column) -> Column:
    """Display status: NULL/'' -> Pending; known spellings mapped; else raw."""
    key = F.lower(js_trim(raw))
    out = F.when(raw.isNull() | (raw == ""), F.lit("Pending"))
    for k, v in STATUS_DISPLAY.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(raw)


def status_rank(raw: Column) -> Column:
    """Board sort rank of ``LOWER(COALESCE(status, 'pending'))``."""
    key = F.lower(F.coalesce(raw, F.lit("pending")))
    out = None
    for k, v in STATUS_RANK.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(0))


def aging_bucket(age_days: Column) -> Column:
    out = None
    for upper, label in AGING_BUCKETS:
        cond = age_days <= upper
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(AGING_OVERFLOW))


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def rounded_minutes_nonneg(start: Column, end: Column) -> Column:
    """Stage duration on the delivery board.

    NULL if either end is NULL; ``Math.round`` of the millisecond difference
    in minutes; NULL when that is negative (-30 s rounds to 0 and is kept).
    """
    ms = F.unix_millis(end) - F.unix_millis(start)
    m = F.floor((ms + F.lit(30_000)).cast("double") / F.lit(60_000.0))
    return F.when(m >= 0, m)


def round_ratio(num: Column, den: Column) -> Column:
    """Exact ``round(num / den)`` half away from zero as BIGINT, for integer
    (or integral decimal) ``num`` and positive integer ``den``; NULL when
    ``den`` is 0 or NULL. PostgreSQL ``ROUND(AVG(int))`` semantics, computed
    without an intermediate rounded quotient."""
    d2 = den.cast("decimal(38,0)") * F.lit(2).cast("decimal(38,0)")
    n2 = (F.abs(num).cast("decimal(38,0)") * F.lit(2).cast("decimal(38,0)")
          + den.cast("decimal(38,0)")).cast("decimal(38,0)")
    # floor(n2 / d2): subtract the remainder first so the division is exact.
    q = ((n2 - n2 % d2) / d2).cast("bigint")
    return F.when(den > 0, q * F.signum(num).cast("bigint"))


def round_mean_minutes(sum_us: Column, weight: Column) -> Column:
    """Exact ``round(sum_us / weight / 60e6)`` half away from zero, as BIGINT:
    the rounded mean, in minutes, of microsecond differences."""
    return round_ratio(sum_us, weight.cast("decimal(38,0)") * F.lit(_US_PER_MINUTE).cast("decimal(38,0)"))


def fmt_minutes(m: Column) -> Column:
    """``Xh Ym`` when the floor hour is positive, else ``Ym``; NULL stays NULL."""
    h = F.floor(m / F.lit(60))
    mm = m % F.lit(60)
    return (F.when(m.isNull(), F.lit(None).cast("string"))
             .when(h > 0, F.format_string("%dh %dm", h, mm))
             .otherwise(F.format_string("%dm", mm)))
